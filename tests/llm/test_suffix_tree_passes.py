import numpy as np
import pytest

from tillpoint.llm import suffix_tree as st


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_distinct_keys(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    keys = np.concatenate([keys, keys[: n // 2], keys[: n // 3] ^ np.uint64(1)])  # equal, and equal but for the lowest bit
    own, where, inverse = st._distinct(keys)
    plain, expected = np.unique(keys, return_inverse=True)
    assert (own == plain).all() and (inverse == expected).all() and (keys[where] == own).all()
    if n:
        assert (st._keys(st._planes(own)) == own).all()


def test_contexts_go_to_the_shards_by_rank_not_by_key():
    """A block names a run to its shard by the step of its rank: a byte, not eight."""
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    own = [np.sort(rng.choice(pool, 8000, replace=False)) for _ in range(3)]
    data = [(st._planes(k), rng.integers(0, 3, len(k)).astype(np.uint8)) for k in own]
    total = {}
    for k, (_, n) in zip(own, data):
        for key, c in zip(k.tolist(), n.tolist()):
            total[key] = total.get(key, 0) + c
    ranked = sorted(k for k, c in total.items() if c >= st.LEAST)
    once = []
    for k, (said, steps) in zip(own, st._totals(data, 2)):
        assert [x >> 1 for x in said.tolist()] == [total[x] if total[x] >= st.LEAST else 0 for x in k.tolist()]
        asked = k[said >= 2 * st.LEAST]
        assert [ranked[r] for r in np.cumsum(steps)] == asked.tolist()
        assert len(st._pack(st._narrow(steps))) < 2 * len(asked)
        once += k[(said & 1).astype(bool)].tolist()
    assert sorted(once) == ranked  # each summed up by one block


def test_a_pass_shuffles_no_text(spark, make):
    """The rows that the passes group by block hold a place in a file, not the block."""
    from tests.llm.conftest import sentence
    from tillpoint.llm.common import scratch_dir

    docs = make([(k, sentence(k, 3000)) for k in range(6)]).select("doc_id", "text")
    rows = st.blocks(docs, f"{scratch_dir(spark)}/pst-test").drop("words").collect()
    assert sum(r.size for r in rows) > 6000 and all(len(str(r.asDict())) < 500 for r in rows)
    import pyarrow as pa
    table = pa.Table.from_pylist([r.asDict() for r in rows])
    ids = [i for _, data in st._payloads(table) for i in st._unpack(data)[0]]
    assert sorted(ids) == list(range(6)) and sum(r.train_tokens for r in rows) % 3001 == 0


def test_answers_are_written_once_and_read_in_place(spark, tmp_path):
    """A shard's rows hold places of its answers in a file, not the answers."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    own = {b: np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)) for b in range(3)}
    own[1] = own[0]
    counts = rng.integers(1, 200, len(own[0]))
    rows = [(b, 7, 2, st._pack(st._planes(k), (counts if b < 2 else np.ones(len(k))).astype(np.uint8))) for b, k in own.items()]
    found = st._count(1.0, str(tmp_path))(st._rows(rows, st._PARTS))
    assert sum(len(str(r)) for r in found.to_pylist()) < 1000 < sum(found["size"].to_pylist())
    assert sum(found["n_known"].to_pylist()) == len(own[0])
    for b in own:
        said, steps = st._told(found.filter(pa.compute.equal(found["block"], b)), str(tmp_path))[2, 7]
        assert (said >> 1 == (0 if b == 2 else 2 * counts)).all() and len(steps) == (0 if b == 2 else len(own[0]))


def test_blocks_span_batches(spark, make):
    """A block is as large as its bytes allow, whatever the Arrow batches are."""
    from tillpoint.llm.common import scratch_dir

    docs = make([(k, f"a b w{k}") for k in range(90)]).select("doc_id", "text").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = st.blocks(docs, f"{scratch_dir(spark)}/pst-span").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(rows) == 1 and sum(r.train_tokens for r in rows) % 4 == 0


def test_places_are_dealt_to_all_tasks(spark, make):
    """Rows of places are few bytes, which Spark would put in one task."""
    docs = make([(k, f"a b w{k}") for k in range(9)]).select("doc_id", "text")
    plan = st.score(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2
