"""Phrase mining, whitening and packing against brute force, and on awkward tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourweave.llm import language, packing, phrases, pieces, queries, whitening
from tests.llm.helpers import none, odd, rows

SF = "/root/testdata/sf0.001"


# --- phrases ---------------------------------------------------------------

def mined_plainly(docs, least, longest=5, top=2000):
    """docs: (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        good = {p: c for p, c in counts.items() if c >= least and len(p) > 1}
        rows = []
        for p, a in good.items():
            longer = [q for q in good if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * good[q] >= 100 * a for q in longer):
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, x, y) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -score))
    return sorted(out)


def talk(seed, n):
    r = random.Random(seed)
    pool = ["the", "The", "of", "zürich", "x", "ein", "日本", "y"] + [f"w{i}" for i in range(30)]
    text = "".join(r.choices(pool, [9, 3, 6, 2, 2, 2, 2, 1] + [1] * 30)[0] + r.choice([" ", "  ", "\t", ", ", ". ", "\n", " ", " ", "\xa0"]) for _ in range(n))
    return text + " a very common passage of words "


@pytest.mark.parametrize("task_pointers, max_words", [(3_000_000, 2_000_000), (40, 2_000_000), (40, 0)])
def test_phrases(spark, task_pointers, max_words):
    docs = [(None if i % 5 == 0 else "und" if i % 7 == 0 else "ab"[i % 2], talk(i, 120)) for i in range(60)]
    docs += [("a", None), ("b", ""), ("a", " \t "), (None, "x " * 3000), ("c", "only here")]
    df = spark.createDataFrame(docs, "lang string, text string").withColumns({c: F.lit(c) for c in ("f", "n", "phrase", "code", "w1")})
    got = phrases.collocations(df, least=8, task_pointers=task_pointers, max_words=max_words)
    assert sorted(tuple(r) for r in got.collect()) == mined_plainly(docs, 8)
    best = phrases.collocations(df, least=8, top=3, task_pointers=task_pointers, max_words=max_words)
    assert sorted(tuple(r) for r in best.collect()) == mined_plainly(docs, 8, top=3)


def test_phrase_scores_pass_64_bits():
    counts = dict(phrases.quicksort_counts(np.array([[5, 5, 7, 5], [9, 9, 0, 0]]), np.array([10**15, 1, 4, 2]), 3))
    assert counts == {(5,): 10**15 + 3, (5, 9): 10**15 + 1, (7,): 4}


def test_phrases_of_odd_tables(spark):
    got = phrases.collocations(odd(spark), least=2)
    assert sorted(tuple(r) for r in got.collect()) == mined_plainly([(r[2], r[1]) for r in rows()], 2)
    assert phrases.collocations(none(spark)).collect() == []


def test_phrase_query(spark):
    docs = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op11_phrase_mining(spark, SF).collect()) == mined_plainly(docs, 100)


# --- whitening -------------------------------------------------------------

def test_eigenvectors():
    r = np.random.default_rng(0)
    close = np.eye(40) * 2 + np.diag([3.0] + [0] * 39)
    turned = np.linalg.qr(r.standard_normal((40, 40)))[0]
    for c in (np.cov(r.standard_normal((300, 60)).T), close, turned @ close @ turned.T, np.array([[2.0]]), np.diag([4.0, 9.0])):
        values, u = whitening.components(c)
        assert np.allclose(values, np.linalg.eigvalsh(c)[::-1][: len(values)], rtol=1e-12)
        assert np.abs(u.T @ u - np.eye(len(values))).max() < 1e-12
        assert np.abs(c @ u - u * values).max() < 1e-12 * np.abs(c).max() * len(c)


def check_whitened(vectors, got):
    usable = {i: v for i, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v)}
    for d in {len(v) for v in usable.values()}:
        x = {i: np.floor(np.array(v, float) * 64) + 1000000 for i, v in usable.items() if len(v) == d}
        fit = np.unique(np.stack(list(x.values())), axis=0)
        n, total = len(fit), fit.sum(0)
        v = np.cov(fit.T, bias=True).reshape(d, d)
        values = np.linalg.eigvalsh(v)[::-1]
        k = int((values[:16] > 1e-10 * max(np.trace(v), 1e-300)).sum()) if np.trace(v) > 0 else 0
        z = defaultdict(dict)
        for r in got:
            if r["vec_id"] in x:
                z[r["vec_id"]][r["component"]] = r["whitened"]
                exact = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[r["vec_id"]], total))
                assert (r["n"], r["deviation"]) == (n, exact if exact < 2**63 else None)
                assert np.isclose(r["explained"], values[r["component"] - 1] / np.trace(v), rtol=1e-9)
                assert r["identity_error"] < 1e-9
        if not k:
            assert not z
            continue
        assert sorted(z) == sorted(x) and all(sorted(w) == list(range(1, k + 1)) for w in z.values())
        whole = {tuple(x[i]): [z[i][c + 1] for c in range(k)] for i in x}
        w = np.array([whole[tuple(f)] for f in fit])
        assert np.abs(np.cov(w.T, bias=True).reshape(k, k) - np.eye(k)).max() < 1e-8
        for c in range(k):  # each is a direction of the covariance
            u = np.linalg.lstsq(fit - total / n, w[:, c], rcond=None)[0]
            assert np.allclose(v @ u, values[c] * u, atol=1e-6 * np.abs(v @ u).max())


def test_whitening(spark):
    r = np.random.default_rng(3)
    vectors = [list(map(float, v)) for v in r.standard_normal((80, 20)) * np.linspace(1, 4, 20)]
    vectors += [vectors[0], vectors[1], None, [], [None] * 20, [float("nan")] * 20, [float("inf")] + [0.0] * 19]
    vectors += [[1.0, 2.0], [3.0, 2.0], [3.0, 5.0], [7.0], [7.0], [1.0, 1.0, 1.0], [1e9, 2.0, 3.0, 4.0], [-1e9, 0.5, 3.0, 4.0]]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, x string, n int")
    got = whitening.whiten(df.repartition(4)).collect()
    check_whitened(vectors, got)
    assert whitening.whiten(df.limit(0)).collect() == []
    twice = whitening.whiten(df.where("vec_id < 2").union(df.where("vec_id < 2")).withColumn("vec_id", F.lit(None).cast("bigint")))
    assert [r["vec_id"] for r in twice.collect()] == [None] * 4


def test_whitening_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    assert [r["vec_id"] for r in table] == list(range(len(table)))
    check_whitened([r["embedding"] for r in table], queries.op12_whitening(spark, SF).collect())


# --- packing ---------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    return pieces.read_model(queries.WORDS).decode()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.WORDS)


def test_word_ids_are_the_tokenizers(tokenizer, model):
    own = packing.WordIds(model)
    texts = [r[1] or "" for r in rows()]
    texts += ["á é̂ Ａ ΑΣ ΑΣ. İ ǅ", "x y z\x1c1\x85q", "<|endoftext|> a<|startoftext|>b", "it's I'LL 12½ ﻿​", "́ \ńx"]
    r = random.Random(5)
    pool = "abcXYZ019.,'!? \n\t\r\x0b\x0céßǺ̧Σσς日本語ก็🙂‍ 　<|>_-"
    texts += ["".join(r.choices(pool, k=r.randrange(60))) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def check_packed(found, docs, tokenizer, window=2048):
    """docs: (doc_id, text). Every id lies in one piece, sequences are gapless and full or powers of two."""
    want = Counter()
    for doc_id, text in docs:
        want[doc_id, tuple(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] > 0
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end == window or end & (end - 1) == 0 and end < window
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    if all(n == 1 for n in want.values()) and len({d for d, _ in want}) == len(want):
        for (doc_id, n), parts in by_doc.items():
            whole = []
            for start, ids in sorted(parts):
                assert start == len(whole)
                whole += ids
            assert len(whole) == n and want.pop((doc_id, tuple(whole))) == 1
        assert not want
    else:
        assert Counter(x for p in by_doc.values() for _, ids in p for x in ids) == sum(
            (Counter({x: c * k for x, c in Counter(ids).items()}) for (_, ids), k in want.items()), Counter()
        )


def served_in_turn(sizes, window):
    """Deficit round-robin step by step: ids each queue hands over per round."""
    total, first = sum(sizes), [((i + 1) * 0.6180339887498949) % 1 for i in range(len(sizes))]
    counters, left, out = list(first), list(sizes), []
    while sum(left):
        row = []
        for i, size in enumerate(sizes):
            counters[i] += window * size / total
            take = min(int(counters[i] + 1e-9), left[i])
            counters[i] -= take
            left[i] -= take
            row.append(take)
        out.append(row)
        if len(out) > total // window + 1:
            break
    return out


def test_rounds_are_deficit_round_robin():
    sizes = [70_000, 31_000, 7, 4_001, 15]
    rounds = packing.Rounds(sizes, sizes)
    served = np.diff(rounds.served(np.arange(rounds.rounds + 1)), axis=0)
    step = np.array(served_in_turn(sizes, 2048))
    assert (served[: len(step) - 2] == step[:-2]).all()
    assert served.sum(0).tolist() == sizes


def test_windows_hold_the_mixture(spark, model, tokenizer):
    r = random.Random(2)
    docs = [(i, " ".join(f"w{r.randrange(50)}" for _ in range(r.randrange(1, 400))), "aab" [i % 3] if i % 10 else None) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(5)
    found = packing.pack(df, model, window=256).collect()
    check_packed(found, [d[:2] for d in docs], tokenizer, 256)
    source = {d[0]: d[2] for d in docs}
    total = Counter()
    for x in found:
        total[source[x["doc_id"]]] += x["length"]
    mix = defaultdict(Counter)
    for x in found:
        mix[x["sequence_id"]][source[x["doc_id"]]] += x["length"]
    whole = [m for m in mix.values() if sum(m.values()) == 256]
    for m in whole:
        for s, n in total.items():
            assert abs(m[s] - 256 * n / sum(total.values())) <= len(total) + 1
    # a stated weight holds until its source runs dry
    tilted = packing.pack(df, model, window=256, weights={"b": 3, "a": 1, None: 1}).collect()
    check_packed(tilted, [d[:2] for d in docs], tokenizer, 256)
    early = Counter()
    for x in tilted:
        if x["sequence_id"] < 20:
            early[source[x["doc_id"]]] += x["length"]
    assert abs(early["b"] / sum(early.values()) - 0.6) < 0.01
    # more sources than queues: the others share one
    few = packing.pack(df, model, window=256, max_queues=1).collect()
    check_packed(few, [d[:2] for d in docs], tokenizer, 256)


def test_packing_odd_tables(spark, model, tokenizer):
    found = packing.pack(odd(spark), model).collect()
    check_packed(found, [r[:2] for r in rows()], tokenizer)
    assert packing.pack(none(spark), model).collect() == []
    text_ids = spark.createDataFrame([("a", "one two", "s"), (None, None, None)], "doc_id string, text string, source string")
    check_packed(packing.pack(text_ids, model).collect(), [("a", "one two"), (None, None)], tokenizer)


def test_sequences(spark, model):
    found = packing.pack(odd(spark), model)
    whole = packing.sequences(found).collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in whole)
    assert sum(r["length"] for r in whole) == found.agg(F.sum("length")).head()[0]


def test_packing_query(spark, tokenizer):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in docs.items()}
    got = queries.op13_packing(spark, SF).collect()
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(ids[r["doc_id"]]), zlib.crc32(part.tobytes()))
    check = Counter()
    for r in got:
        check[r["doc_id"]] += r["length"]
    assert check == {i: len(x) for i, x in ids.items()}


# --- a language of few, much repeated texts ---------------------------------

def test_a_language_of_copies_is_learned(spark):
    german = "der hund und die katze liefen über die straße und fanden nichts als regen und wind in der nacht"
    r = random.Random(1)
    pool = "the of and to in that it was he for on with as his at by had not are but from or have an they".split()
    english = [" ".join(r.choices(pool, k=30)) for _ in range(3000)]
    rows = [(i, german, "de") for i in range(6000)] + [(6000 + i, t, "en") for i, t in enumerate(english)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    taken = language.sampled(docs, sample=1000, per_language=200)
    assert {x["lang"]: x["count"] for x in taken.groupBy("lang").count().collect()} == {"de": 1, "en": 200}
    assert sorted(taken.collect()) == sorted(language.sampled(docs.repartition(7), sample=1000, per_language=200).collect())
    found = language.predict(docs.where("doc_id % 500 = 0"), language.fit(docs)).select("doc_id", "lang_pred").collect()
    assert {x.lang_pred for x in found if x.doc_id < 6000} == {"de"} and {x.lang_pred for x in found if x.doc_id >= 6000} == {"en"}


# --- the mix in training order ---------------------------------------------

def test_mix_query_is_range_sorted_by_position(spark):
    got = [r.position for r in queries.op4_source_mix(spark, SF).collect()]
    taken = [p for p in got if p is not None]
    assert taken and taken == sorted(taken) == got[: len(taken)] and 0 <= taken[0] <= taken[-1] <= 1
