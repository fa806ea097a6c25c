
import pytest

import corpus_pipeline
from catwarden.llm import decontamination, minhash_dedup, pii, quality, queries
from tests.oracle_harness import compare, duck

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    queries.prepare(spark)


def test_items_without_id_hit(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    items = [(None, " ".join(words[:15])), (None, " ".join(words[20:36])), (7, " ".join(words[30:45])), (8, None), (None, None)]
    docs = [(i, " ".join(words[i:i + 25])) for i in range(40)] + [(90, None), (91, "")]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duck("/none")
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")

    class Q:
        spark, sql = staticmethod(queries.QUERIES["op6_decontamination"]), queries.ORACLES["op6_decontamination"]

    assert compare(spark, con, "op6_decontamination", Q, str(tmp_path))["status"] == "ok"
    d, it = (queries.table(spark, str(tmp_path), t) for t in ("documents", "benchmark"))
    one = {r.doc_id: r.hit for r in decontamination.hits(d, it).collect()}
    assert (one[0].n_hit, one[0].n_items, one[0]["items"]) == (15, 1, [])
    assert (one[20].n_hit, one[20].n_items, one[20]["items"]) == (25, 2, ["7"])
    assert not {r.doc_id for r in decontamination.remove_contaminated(d, it).collect()} & {0, 20}
    assert one == {r.doc_id: r.hit for r in decontamination.hits(d, it, block_bytes=60).collect()}


def test_spans_of_several_blocks_join_by_words(spark):
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(words[13 * i:13 * i + 13])) for i in range(4)] + [(9, "é 1")]
    docs = [(1, "Q, " + ",  ".join(words) + "! É é-1?"), (2, "é 1"), (3, None)]
    d, it = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    one = {r.doc_id: r.hit for r in decontamination.hits(d, it).collect()}
    assert len(one[1].spans) == 2 and one[1].n_hit == 54
    assert one == {r.doc_id: r.hit for r in decontamination.hits(d, it, block_bytes=40).collect()}


def test_lines_without_digits_are_decoded(spark):
    rows = ("the password hunter|secret was leaked", "bob|email [at]|email host|email dot|email com|email today",
            "a plain word is here", "no other words are here", "we met and the page was read")
    text = "plain words\nmy password letters was leaked\nann [at] site dot org today"
    want = [(text.index("letters"), text.index("letters") + 7, "secret"), (text.index("ann"), text.index(" today"), "email")]
    assert pii.field_spans(pii.train(rows), [None, "", text])[2] == want
    got = pii.find(spark.createDataFrame([(1, text), (2, None)], SCHEMA), rows=rows).orderBy("doc_id").collect()
    assert got[0].pii.spans == pii.spans_text([(a, b, k) for a, b, k in want]) and got[0].pii.n_added == 2
    assert got[1].pii.spans == ""


def test_shapes_of_whole_tokens():
    assert pii.shape("a" * 300 + "9") == "a9" and pii.shape("a9" * 10) == "a9" * 10
    assert "t:" + "a9" * 4 in pii._own("a9" * 10)
    assert quality._token("x" * 100 + "1")[1] == quality._token("x1")[1] != quality._token("x")[1]


def test_near_dedup_stage_names_its_shingle_size(spark, monkeypatch):
    words = [f"w{i}" for i in range(41)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:20], "new", *words[21:]]))], SCHEMA)
    # 34 of 42 shingles of four words are common, 32 of 42 of five
    assert minhash_dedup.keep_one(docs, size=4).count() == 1
    assert minhash_dedup.keep_one(docs, size=5).count() == 2
    asked = []
    monkeypatch.setattr(minhash_dedup, "keep_one", lambda d, **named: asked.append(named) or d)
    corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert asked == [{"size": 4}]
