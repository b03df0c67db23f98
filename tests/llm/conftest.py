import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def sentence(seed: int, n: int) -> str:
    """n words that depend on the seed; two seeds share no run of words."""
    rnd = random.Random(seed)
    return " ".join(f"{rnd.choice(WORDS)}{rnd.randrange(1000)}" for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows."""
    def build(rows, extra=False):
        full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "s0")), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:  # names that the operators use themselves
            for name in ("fp", "h", "size", "score", "component_id", "th", "shard", "block", "n"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df.repartition(3)
    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and blank texts, repeated rows, ties and a very long text."""
    long = " ".join(sentence(1000 + k, 80) for k in range(400))
    return make([(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (5, sentence(1, 60)), (6, sentence(1, 60)), (None, sentence(2, 60)),
                 (7, long), (8, sentence(3, 60), None, None), (9, "ÉÑ ü x", "fr", ""), (10, "#*$ 123 <|>")], extra=True)


@pytest.fixture(scope="session")
def none(make):
    return make([])
