"""Corpus operators against brute force on small tables and odd rows."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from catwarden.llm import (decontamination, exact_dedup, line_dedup, minhash_dedup, pii, quality, queries,
                           sentencepiece_codec, token_counts, toxicity, url_filters)
from tests.conftest import SMALL_SF
from tests.oracle_harness import compare, duck

ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "a"), (4, "a"), (5, "A"), (None, "a"), (6, "x " * 30_000), (7, "é ñ\nÉ")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    queries.prepare(spark)


@pytest.fixture(scope="module")
def odd(spark):
    # an extra column whose name clashes with names the operators use inside
    return spark.createDataFrame([(*r, "z") for r in ODD], SCHEMA + ", n string")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    class Q:
        pass

    q = Q()
    q.spark, q.sql = queries.QUERIES[name], queries.ORACLES[name]
    assert compare(spark, duck(SMALL_SF), name, q, SMALL_SF)["status"] == "ok"


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(none, labels).count() == 0
    assert quality.quality(none, labels).count() == 0
    assert pii.find(none).count() == 0
    assert sentencepiece_codec.decode(sentencepiece_codec.encode(none)).count() == 0
    assert exact_dedup.exact_groups(none).count() == 0
    assert minhash_dedup.near_duplicates(none).count() == 0
    assert decontamination.hits(none, items).count() == 0
    assert token_counts.token_report(token_counts.with_token_counts(none)).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.filter_urls(pages, url_filters.rules_frame(spark)).count() == 0


def test_odd_rows_keep_their_number(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, None), (2, ""), (3, "x x x"), (3, "x x x")], "item_id long, text string")
    n = len(ODD)
    assert toxicity.toxicity(odd, labels).count() == n
    assert quality.quality(odd, labels).count() == n
    assert pii.find(odd).count() == n
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(odd))
    assert back.where("decoded <> coalesce(text, '')").count() == 0
    once = sentencepiece_codec.encode_checked(odd)
    assert once.where("not round_trip").count() == 0 and once.columns == [*odd.columns, "ids", "round_trip"]
    assert sorted(map(str, once.select("doc_id", "ids").collect())) == sorted(map(str, back.select("doc_id", "ids").collect()))
    assert exact_dedup.exact_groups(odd).count() == n
    near = minhash_dedup.near_duplicates(odd)
    assert near.count() == n
    got = {r.doc_id: r for r in near.collect()}
    assert got[5].component_id == 4 and not got[5].kept and got[3].n_shingles == 0 and got[3].kept and got[None].kept
    hit = rows(decontamination.hits(odd, items))
    assert hit[1].hit.n_words == 0 and hit[6].hit.n_hit == 30_000 and hit[6].hit["items"] == ["3"]
    assert token_counts.with_token_counts(odd).count() == n
    left = line_dedup.dedup_lines(odd)
    assert left.count() == n and left.columns == ["doc_id", "text", "n", "line_count", "lines_deleted"]


def test_pii_against_plain_patterns():
    plain = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def naive(t):
        out = []
        for k, p in enumerate(plain):
            for m in re.finditer(p, t):
                digits = re.sub(r"\D", "", m[0])
                good = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True,
                        k != 2 or 14 <= len(digits) <= 19 and pii.luhn(digits), k != 3 or 10 <= len(digits) <= 15)
                if all(good):
                    out.append((m.start(), m.end(), k))
        return [(a, b, pii.KINDS[k]) for a, b, k in sorted(out, key=lambda s: (s[0], s[2]))]

    rng = random.Random(1)
    for _ in range(5_000):
        t = "".join(rng.choice("1234567890..@@ab+-() ") for _ in range(rng.randint(1, 60)))
        assert naive(t) == pii.base_spans(t), t
    field = pii.train()
    text = "log: password=9f3e7c6d5b4a1 of jo@x.example.org"
    spans = pii.all_spans(pii.base_spans(text), pii.field_spans(field, [text])[0])
    assert [k for _, _, k in spans] == ["secret", "email"]


def test_viterbi_is_the_best_path():
    from sentencepiece import sentencepiece_model_pb2 as pb

    raw = open(sentencepiece_codec.DEFAULT_MODEL, "rb").read()
    codec, proto = sentencepiece_codec.Codec(raw), pb.ModelProto()
    proto.ParseFromString(raw)
    score = {p.piece: p.score for p in proto.pieces if p.type == 1}

    def best(s):  # every piece tried at every place
        top = [0.0]
        for end in range(1, len(s) + 1):
            ways = [top[k] + score[s[k:end]] for k in range(max(0, end - 20), end) if s[k:end] in score]
            top.append(max(ways))
        return top[-1]

    for t in ("the cat sat", "Hello world", "anthropology and the rest", "of the inanin", "Thon onorlyhe the thenoning"):
        assert sum(proto.pieces[i].score for i in codec.encode(t)) == best("▁" + t.replace(" ", "▁"))
    for t in ("a ▁ b", "日本\n 🙂", "  two  blanks ", "▁"):
        assert codec.decode(codec.encode(t)) == t


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 8, 30, 120]))] for _ in range(12)]
    docs = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 7])):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((1000 - i, " ".join(w)))

    def shingles(t):
        w = t.split()
        return {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))}

    sets = {d: shingles(t) for d, t in docs}
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low = min(label[a], label[b])
                    label = {k: low if v in (label[a], label[b]) else v for k, v in label.items()}
                    changed = True
    for small in (32, 1):  # both ways to the rest of a star
        minhash_dedup.SMALL_STAR = small
        got = rows(minhash_dedup.near_duplicates(spark.createDataFrame(docs, SCHEMA)))
        assert {d: r.component_id for d, r in got.items()} == label
        assert all(r.n_shingles == len(sets[d]) for d, r in got.items())
    minhash_dedup.SMALL_STAR = 32


def test_lines_against_all_runs(spark):
    rng = random.Random(2)
    vocab = ["a", "b c", "", "d", "e f g", "  ", "h i"]
    docs = [(i, "\n".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 12, 25])))) for i in range(40)]
    docs += [(100 + i, docs[i][1]) for i in range(3)] + [(200, "x y z\n" * 6)]
    for least in (3, 8):
        seen, want = {}, {}
        for d, t in docs:
            lines, gone = t.split("\n"), set()
            for i in range(len(lines)):
                n = 0
                for j in range(i, len(lines)):
                    n += len(lines[j].split())
                    if n >= least:
                        run = tuple(lines[i:j + 1])
                        if seen.setdefault(run, (d, i)) < (d, i):
                            gone.update(range(i, j + 1))
            want[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        got = rows(line_dedup.dedup_lines(spark.createDataFrame(docs, SCHEMA), min_words=least))
        assert {d: r.text for d, r in got.items()} == want


def test_blocks_of_items_give_the_same_hits(spark):
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(words[i:i + 15])) for i in range(20)] + [(50, "w1 W2")]
    docs = [(i, "Z! " + " ".join(words[i:i + 20]) + " q" * i) for i in range(30)]
    d, it = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    one = {k: (r.hit.n_words, r.hit.n_hit, r.hit["items"]) for k, r in rows(decontamination.hits(d, it)).items()}
    many = {k: (r.hit.n_words, r.hit.n_hit, r.hit["items"]) for k, r in rows(decontamination.hits(d, it, block_bytes=300)).items()}
    assert one == many and any(v[1] for v in one.values())


def test_columns_of_any_name_pass_through(spark):
    extra = {"score": 1.5, "hit": "h", "hit0": "a", "hit1": "b", "id": "i", "ver": "v", "runs": "r", "run_id": "q",
             "line_count": "c", "Lines_Deleted": "d", "n_chars": 7, "lang": "xx", "source": "s"}
    shared = "\n".join(" ".join(f"w{i}x{j}" for j in range(30)) for i in range(3))
    data = [(1, shared + "\nfirst", *extra.values()), (2, "second\n" + shared, *extra.values()), (3, None, *extra.values()),
            (4, "to be asked in a test", *extra.values())]
    docs = spark.createDataFrame(data, ["doc_id", "text", *extra])
    model = toxicity.train([], np.zeros(0))
    assert sorted(map(str, toxicity.remove_toxic(docs, model).collect())) == sorted(map(str, docs.collect()))
    items = spark.createDataFrame([(1, "asked in a test"), (2, "nowhere at all")], "item_id long, text string")
    clean = decontamination.remove_contaminated(docs, items)
    assert clean.columns == docs.columns and sorted(rows(clean)) == [1, 2, 3]
    united = decontamination.hits(docs, items, block_bytes=8, out_col="hit")
    assert rows(united)[4].hit["items"] == ["1"] and rows(united)[4].hit0 == "a"
    left = corpus_pipeline.drop_repeated_lines(spark, docs, SMALL_SF)
    got = rows(left)
    assert left.columns == docs.columns and got[2].text == "second" and got[2].n_chars == 6 and got[1].n_chars == 7
    assert all(r[k] == v for r in got.values() for k, v in extra.items() if k != "n_chars")


def test_texts_without_words_teach_no_word():
    y = np.array([1, 0] * 200)
    texts = [None, "plain"] * 200  # the toxic ones have no words
    model = toxicity.train(texts, y).scorer()
    assert model.score("plain") < 0.5


def test_models_learn():
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("bal", "mor", "tin") for b in "aeiou" for c in ("ra", "lo", "net")]
    def doc(bad):
        w = [rng.choice(words) for _ in range(40)]
        if bad:
            w[5] = rng.choice(["grumbles", "grumbled", "grumbler"])
        return " ".join(w)
    y = np.array([i % 2 for i in range(300)])
    model = toxicity.train([doc(v) for v in y], y).scorer()
    assert np.mean([(model.score(doc(v)) >= 0.5) == v for v in [0, 1] * 100]) > 0.95
    # a form never seen shares n-grams with those that were
    assert model.word("grumbling") > max(model.word(w) for w in words)
    grades = np.array([i % 4 for i in range(400)])
    texts = [" ".join(["good"] * g + ["bad"] * (3 - g) + [rng.choice(words) for _ in range(5)]) for g in grades]
    m = quality.train(texts, grades, 4)
    assert (np.diff(m.thresholds) >= 0).all()
    means = [np.mean([m.over(m.line(t)).sum() for t, g in zip(texts, grades) if g == k]) for k in range(4)]
    assert means == sorted(means)


def test_truncated_totals(spark):
    counted = spark.createDataFrame([(n,) for n in (0, 3, 3, 7, 9_000, 5_000)], "n_tokens long")
    sums = rows(token_counts.token_report(counted), "n_tokens")
    lengths = [0, 3, 3, 7, 9_000, 5_000]
    for n, r in sums.items():
        assert r.truncated == sum(min(n, x) for x in lengths) and r.docs_over == sum(x > n for x in lengths)
    assert token_counts.quantile(token_counts.token_report(counted), 0.5).first()[0] == 3
    assert token_counts.truncated_total(token_counts.token_report(counted), 10).first()[0] == 33


def test_held_out_fold(spark):
    got = rows(queries.QUERIES["op1_toxicity"](spark, SMALL_SF))
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    out = corpus_pipeline.run(spark, SMALL_SF).collect()
    assert out and all(r.round_trip for r in out) and len({r.doc_id for r in out}) == len(out)
