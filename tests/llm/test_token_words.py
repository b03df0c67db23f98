from array import array

from tillpoint.llm import binary_output as bo

ODD = "don't 'save \"'s it's'x ''s 12ab3 a_b <|endoftext|> <b> größe; «x» ümlaut' x² ½ ..., a-b c'd'll é! (é) \x1cx a\x1fb `a` ~ ^ {z} it. ., 7, [x] 'll,"


def test_words_with_marks_go_by_their_pre_tokens(monkeypatch):
    """Each word's ids are the tokenizer's own, and ASCII words need not its whole chain."""
    path = bo.default_vocabulary()
    tok = bo._tokenizer(path)
    monkeypatch.setattr(bo, "_CACHES", {})
    words = list(dict.fromkeys(ODD.encode().split()))
    expected = [array("I", tok.encode(w.decode(), add_special_tokens=False).ids).tobytes() for w in words]
    assert bo.word_ids(words, path) == expected == bo.word_ids(words, path)
    assert bo._pieces(b"(don't)") == [b"(", b"don", b"'t", b")"]
    whole = [w for w in words if bo._pieces(w) is None and w.isascii()]
    assert whole and all(b"<" in w or not w.decode().isprintable() for w in whole)
