"""op11 to op13 against brute force, and odd rows."""

import collections
import hashlib
import itertools
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from catwarden.llm import language_id, queries, token_alignment, vector_codes
from tests.conftest import SMALL_SF
from tests.llm.test_operators import ODD, SCHEMA


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    queries.prepare(spark)


# --- language ----------------------------------------------------------------

def test_forward_backward_equals_all_label_sequences():
    rng = np.random.default_rng(1)
    k, lengths = 3, np.array([2, 4, 1, 3, 0])
    emit = [rng.normal(size=(n, k)) * 2 for n in lengths]
    trans, start = rng.normal(size=(k, k)), rng.normal(size=k)
    lines = language_id.Lines(lengths)
    flat = np.empty((int(lengths.sum()), k))
    flat[lines.place] = np.concatenate(emit)
    got, expected, log_z = language_id.forward_backward(lines, flat, trans, start)
    got = got[lines.place]
    at, all_z, pairs = 0, 0.0, np.zeros((k, k))
    for e in emit:
        if not len(e):
            continue
        weights = {}
        for y in itertools.product(range(k), repeat=len(e)):
            s = start[y[0]] + sum(e[t, y[t]] for t in range(len(e))) + sum(trans[a, b] for a, b in zip(y, y[1:]))
            weights[y] = np.exp(s)
        z = sum(weights.values())
        all_z += np.log(z)
        for t in range(len(e)):
            for j in range(k):
                assert abs(got[at + t, j] - sum(w for y, w in weights.items() if y[t] == j) / z) < 1e-9
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                pairs[a, b] += w / z
        at += len(e)
    assert abs(log_z - all_z) < 1e-9 and np.allclose(expected, pairs)


def test_features_hang_on_the_word_alone():
    one, _ = language_id.features(["straße"])
    ids, starts = language_id.features(["a", "straße", "的"])
    assert sorted(ids[starts[1]:starts[2]]) == sorted(one) and len(one) == sum(8 - n + 1 for n in (1, 2, 3, 4)) + 1


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL_SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = queries.QUERIES["op11_language_id"](spark, SMALL_SF).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_code_switched_words_and_odd_texts(spark):
    rows = [(i, ("the cat and the house " if i % 2 else "der hund und das haus ") * 8, "en" if i % 2 else "de") for i in range(1, 60)]
    rows += [(100, None, "en"), (101, "no label here", None), (None, "the", "de"), (3, "the cat and the house", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.langs == ["de", "en"]
    text = "the cat and the house. der hund und das haus"
    assert model.runs(text) == [(0, 21, "en"), (23, 44, "de")]
    assert language_id.word_runs(docs.limit(1), model).count() == 1
    # an extra column is called as an added one
    odd = spark.createDataFrame([(*r, "z") for r in [*ODD, (8, "12 ² ½ --"), (9, "The Cat")]], SCHEMA + ", found string")
    got = {(r.doc_id, r.text): r for r in language_id.identify(odd, model).collect()}
    assert odd.columns + ["lang_pred", "score"] == language_id.identify(odd, model).columns
    for key in [(1, None), (2, ""), (3, "  \n\t "), (8, "12 ² ½ --")]:
        assert (got[key].lang_pred, got[key].score) == ("und", 0.0)
    assert got[9, "The Cat"].lang_pred == "en" and got[6, "x " * 30_000].lang_pred in ("de", "en")
    nothing = language_id.fit(docs.where("false"))
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}
    assert language_id.identify(odd.where("false"), model).count() == 0


def test_training_reads_no_held_out_document(spark):
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, f"word{'x' * (i % 7)}" if i not in out else "heldout", "aa") for i in range(200)], "doc_id long, text string, lang string")
    assert "heldout" not in {r.text for r in language_id.sample(docs).collect()} and language_id.sample(docs, texts=5).count() == 5


# --- vector codes --------------------------------------------------------------

def test_candidates_hold_the_nearest_entry():
    rng = np.random.default_rng(2)
    for k, width, spread in [(1, 3, 5), (16, 8, 500), (64, 2, 3), (16, 1, 1 << 27), (7, 4, 2)]:
        entries = rng.integers(-spread, spread + 1, size=(k, width))
        x = rng.integers(-spread, spread + 1, size=(400, width))
        index, dist = vector_codes.Slices(entries).nearest(x)
        all_dist = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (index == all_dist.argmin(axis=1)).all() and (dist == all_dist.min(axis=1)).all()
    entries, x = rng.integers(-999, 999, (16, 8)), rng.integers(-999, 999, (400, 8))
    kept = sum(int(m).bit_count() for m in vector_codes.Slices(entries).candidates(x))
    assert kept < 400 * 16


def brute_codes(rows, parts=8, k=16, rounds=6):
    kept = sorted([(i, v) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return {}
    dims = len(kept[0][1])
    width = -(-dims // parts)
    cut = [(i, [[int(np.floor(x * 4096)) for x in v + [0.0] * (width * parts - dims)][p * width:(p + 1) * width] for p in range(parts)]) for i, v in kept if len(v) == dims]
    books = [[c[p] for _, c in cut[:k]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        members = [[[c[p] for _, c in cut if near(p, c[p])[1] == j] for j in range(len(books[p]))] for p in range(parts)]
        books = [[[sum(col) // len(m) for col in zip(*m)] if m else e for m, e in zip(members[p], books[p])] for p in range(parts)]
    return sorted((i, tuple(near(p, c[p])[1] for p in range(parts)), sum(near(p, c[p])[0] for p in range(parts))) for i, c in cut if i is not None)


def test_codes_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=10)]) for i in range(40)]
    rows += [(50, None), (51, []), (52, [1.0] * 9 + [None]), (53, [float("nan")] * 10), (54, [float("inf")] * 10), (55, [1.0] * 4), (7, rows[7][1]), (7, rows[8][1])]
    df = spark.createDataFrame([(*r, None if r[0] % 3 else 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, coded string")
    books = vector_codes.fit(df)
    got = vector_codes.encode(df, books)
    assert got.columns == [*df.columns, "codes", "error"]
    assert sorted((r.vec_id, tuple(r.codes), r.error) for r in got.collect()) == brute_codes([r for r in rows if r[0] != 55])
    sums = vector_codes.with_group_error(got).collect()
    for label in (None, 1):
        assert {r.label_error for r in sums if r.label == label} == {sum(r.error for r in sums if r.label == label)}
    back = vector_codes.decode(got, books).first()
    whole = [v / 4096 for p, c in enumerate(back.codes) for v in books.entries[p, c]][:10]
    assert back.decoded == whole and len(whole) == 10
    assert vector_codes.fit(df.where("false")) is None and vector_codes.encode(df.where("false"), books).count() == 0
    few = vector_codes.fit(df.where("vec_id < 3"))
    assert few.entries.shape == (8, 3, 2) and {r.error for r in vector_codes.encode(df.where("vec_id < 3"), few).collect()} == {0}
    far = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64)], "vec_id long, embedding array<float>")
    seen = vector_codes.encode(far, vector_codes.Codebooks(64, np.full((8, 1, 8), vector_codes.bound(64), dtype=np.int64))).collect()
    assert sorted(r.error for r in seen) == [0, 64 * (2 * vector_codes.bound(64)) ** 2] and seen[0].error < 1 << 63


# --- alignment -----------------------------------------------------------------

def brute_alignment(texts):
    a_side, b_side = Tokenizer.from_file(token_alignment.TOKENIZER_A), sentencepiece.SentencePieceProcessor(model_file=token_alignment.TOKENIZER_B)
    a_side.encode_special_tokens = True
    alphabet = token_alignment.byte_alphabet()

    def ends(raws):
        return list(itertools.accumulate(map(len, raws)))

    out, counts = [], collections.Counter()
    for t in texts:
        a = a_side.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_side.encode(t) if t else []
        raw_a = [bytes(alphabet[c] for c in a_side.id_to_token(i)) for i in a]
        raw_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + (t or "")).encode()
        if not t or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            out.append((0, 0, 0, [], ""))
            continue
        ea, eb = ends(raw_a), ends(raw_b)
        groups, links, last = [], [], 0
        for e in sorted(set(ea) & set(eb)):
            ga, gb = ([i for i, x in zip(ids, es) if last < x <= e] for ids, es in ((a, ea), (b, eb)))
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            links.append((ga[-1], gb[-1]))
            last = e
        counts.update(links)
        out.append((len(a), len(b), len(groups), links, ";".join(groups)))
    top = collections.defaultdict(int)
    for (x, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(n_a, n_b, n_g, g, len(ls), sum(counts[x] == top[x[1]] for x in ls), sum(counts[x] for x in ls)) for n_a, n_b, n_g, ls, g in out]


TEXTS = ["The quick brown fox, don't!", "  leading  and   runs\t\n\n of blanks  ", "naïve café — “quotes”… 12345 ½²", "日本語 and 한국어 🙂🙃 mixed", "▁literal", "a", " ",
         "<s> </s> <unk> <|endoftext|> <0x41>", "​﻿zero width", "ſtrange İi ǅ \x1c\x1f\x85", "x" * 5_000, "tab\tnew\r\nline", "the the the the", "the the the the", "ɏ⁗ ‧‐", None, ""]


@pytest.mark.parametrize("heavy", [0, 5, token_alignment.HEAVY_PAIRS])
def test_alignment_equals_brute_force(spark, heavy):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_links string").repartition(3)
    found = token_alignment.with_link_counts(token_alignment.align(docs), heavy_pairs=heavy)
    got = {r.doc_id: (r.aligned.n_a, r.aligned.n_b, r.aligned.n_groups, r.aligned.groups, r.n_links, r.n_best, r.count_sum) for r in found.collect()}
    for i, want in enumerate(brute_alignment(TEXTS)):
        assert got[i] == want, TEXTS[i]


def test_alignment_of_documents(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL_SF}/documents.parquet").collect()]
    want = {i: w for (i, _), w in zip(texts, brute_alignment([t for _, t in texts]))}
    for r in queries.QUERIES["op13_token_alignment"](spark, SMALL_SF).collect():
        n_a, n_b, n_g, groups, n_l, best, total = want[r.doc_id]
        digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (n_a, n_b, n_g, n_l, best, total, digest)


def test_alignment_of_odd_and_no_rows(spark):
    odd = spark.createDataFrame([(*r, "z") for r in ODD], SCHEMA + ", aligned string")
    found = token_alignment.with_link_counts(token_alignment.align(odd))
    assert found.count() == len(ODD) and {r.aligned.n_a for r in found.where("doc_id in (1, 2)").collect()} == {0}
    assert token_alignment.with_link_counts(token_alignment.align(odd.where("false"))).count() == 0


def test_pointer_jumping_on_long_chains():
    # ends that interleave and meet only at the last byte: one component
    a, b = np.array([*range(2, 4001, 2), 4001]), np.array([*range(1, 4000, 2), 4001])
    ga, gb = token_alignment.jump(a, b)
    assert set(ga) == set(gb) == {0}
    ga, gb = token_alignment.jump(np.array([1, 2, 3]), np.array([1, 2, 3]))
    assert ga.tolist() == gb.tolist() == [0, 1, 2]
