"""Collocation mining: frequent phrases of up to five words, scored by their weakest cut.

1. Words are counted per language. Rarer words than the least count end every phrase, so they cut the texts.
2. Every word that may start a phrase is a suffix pointer; what it points to, its next five words, is dealt to the
   tasks by leading words: by the first word, or, where that one is so frequent that its suffixes would not fit one
   task, by the leading words up to the first less frequent one. Equal suffixes of an Arrow batch travel as one row with
   their number, so neither a frequent word nor a frequent passage fills a task.
3. A task sorts its pointers by multikey three-way quicksort: a partition is split at a pivot word into smaller, equal
   and larger; the equal part has one more word in common, its size is the count of that phrase, and it is split
   at the next word. Partitions smaller than the least count are abandoned.
4. Scores, the drop of phrases that only occur inside longer ones, and the ranking are joins over the frequent phrases.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourweave.session import written

LEAST, LONGEST, TOP = 100, 5, 2000
#: Suffix pointers a task should hold.
TASK_POINTERS = 3_000_000
#: Frequent words sent to the tasks that cut the texts (8 bytes each), which then write words as short numbers; with more of them
#: texts are not cut and words travel as hashes, which costs time and space but changes nothing else. Below 2^21.
MAX_WORDS = 2_000_000
_BATCH_WORDS, _ROW_POINTERS = 2_000_000, 20_000
_CACHED = 300_000
_BREAK = b"\xff"  # never part of UTF-8
_LOWERED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)


def _tokens(text: str) -> list[bytes]:
    """Lower-cased words, with _BREAK between the pieces and at the end."""
    return text.encode().translate(_LOWERED).replace(b"\n", b" \xff ").split() + [_BREAK]


def _counts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, word, n), summed over many texts."""
    found: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, word.decode(), n) for lang, words in found.items() for word, n in words.items() if word != _BREAK]
        found.clear()
        columns = list(zip(*rows)) or [[], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())],
            ["lang", "word", "n"],
        )

    for batch in source:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found.setdefault(lang, Counter()).update(_tokens(text.as_py()))
            if sum(map(len, found.values())) > _CACHED:
                yield flush()
    yield flush()


def _code(lang: str, word: bytes) -> int:
    """The number of a word of a language, above 0; 0 ends a phrase."""
    return (xxhash.xxh3_64_intdigest(word, xxhash.xxh3_64_intdigest(lang.encode())) >> 1) | 1


class _Words:
    """What the tasks know of words: the very frequent ones and, if they are not too many, all frequent ones.

    A suffix holds codes, or the numbers of frequent words from 1 on, the most frequent first; other words are 0 then.
    """

    def __init__(self, codes: list[int], n_hot: int, all_known: bool):
        self.by_number = np.array([0, *codes], np.int64)
        self.all_known = all_known
        self.hot = np.arange(1, n_hot + 1) if all_known else np.sort(self.by_number[1 : n_hot + 1])
        self.type = (np.int32, "int") if all_known else (np.int64, "bigint")

    def lookup(self):
        """(sorted codes, their numbers)."""
        order = np.argsort(self.by_number[1:])
        return self.by_number[1:][order], order + 1

    def codes(self, words) -> np.ndarray:
        return self.by_number[words] if self.all_known else words


class _Codes(dict):
    """Words of one language as codes or numbers."""

    def __init__(self, lang: str, sorted_codes: np.ndarray | None, numbers: np.ndarray | None):
        super().__init__({_BREAK: 0})
        self._lang, self._codes, self._numbers = lang, sorted_codes, numbers

    def __missing__(self, word: bytes) -> int:
        code = _code(self._lang, word)
        if self._codes is not None:
            i = int(np.searchsorted(self._codes, code))
            code = int(self._numbers[i]) if i < len(self._codes) and self._codes[i] == code else 0
        self[word] = code
        return code


def _among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(codes), bool)
    return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _suffixes(longest: int, words_known: _Words, tasks: int):
    """(lang, text) to the distinct suffixes of a batch in order, by task: (route, w1, w2, .., n) with lists of the suffixes'
    words and of how often each occurs; ``route`` is the number of the task."""
    kind, hot = words_known.type[0], words_known.hot

    def sort_keys(words: np.ndarray) -> list[np.ndarray]:
        """The last key first; numbers below 2^21 are sorted three at a time."""
        if not words_known.all_known:
            return list(words[::-1])
        keys = []
        for a in range(0, longest, 3):
            key = np.zeros(words.shape[1], np.int64)
            for w in words[a : a + 3]:
                key = key << 21 | w
            keys.append(key)
        return keys[::-1]

    def pack(codes: np.ndarray) -> pa.RecordBatch:
        codes = np.append(codes, np.zeros(longest, kind))
        at = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
        at = at[at < len(codes) - longest]
        words = np.empty((longest, len(at)), kind)
        words[0] = codes[at]
        for d in range(1, longest):
            words[d] = np.where(words[d - 1] > 0, codes[at + d], 0)
        words = words[:, np.lexsort(sort_keys(words))]  # neighbours differ little: they are counted together, and pack well
        new = np.ones(len(at), bool)
        new[1:] = (words[:, 1:] != words[:, :-1]).any(0)
        heads = np.flatnonzero(new)
        n = np.diff(heads, append=len(at)).astype(np.int32)
        words = words[:, heads]
        route = _mixed(words[0].astype(np.uint64))
        going = _among(words[0], hot)
        for d in range(1, longest):
            route = np.where(going, _mixed(route * np.uint64(31) + words[d].astype(np.uint64)), route)
            going &= _among(words[d], hot)
        route = ((route >> np.uint64(32)) * np.uint64(tasks) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(route, kind="stable")
        words, n, route = words[:, order], n[order], route[order]
        new = np.r_[True, route[1:] != route[:-1]][: len(n)]
        new[::_ROW_POINTERS] = True
        edges = np.flatnonzero(new)
        offsets = pa.array(np.append(edges, len(n)).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(route[edges]), *[pa.ListArray.from_arrays(offsets, pa.array(w)) for w in (*words, n)]],
            ["route", *[f"w{d + 1}" for d in range(longest)], "n"],
        )

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Codes] = {}
        listed = words_known.lookup() if words_known.all_known else (None, None)
        held, size = [], 0
        for batch in source:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if sum(map(len, known.values())) > _CACHED:
                    known.clear()
                if lang not in known:
                    known[lang] = _Codes(lang, *listed)
                tokens = _tokens(text.as_py())
                held.append(np.fromiter(map(known[lang].__getitem__, tokens), kind, len(tokens)))
                size += len(tokens)
                if size > _BATCH_WORDS:
                    yield pack(np.concatenate(held))
                    held, size = [], 0
        if held:
            yield pack(np.concatenate(held))

    return batches


def quicksort_counts(words: np.ndarray, n: np.ndarray, least: int) -> list[tuple[tuple[int, ...], int]]:
    """(phrase, count) of all common beginnings of at least ``least`` pointers, one word or longer.

    ``words`` has a row per depth and a column per pointer, 0 where a suffix has ended; ``n`` says how often each pointer
    counts. Multikey three-way quicksort to the last depth, on a stack of its own.
    """
    found = []
    pointers = np.arange(words.shape[1])
    stack = [(pointers, ())]
    while stack:
        part, prefix = stack.pop()
        if len(part) == 0 or n[part].sum() < least:
            continue  # nothing below can be frequent
        key = words[len(prefix)][part]
        pivot = np.sort(key[[0, len(key) // 2, len(key) - 1]])[1]
        smaller, equal = part[key < pivot], part[key == pivot]
        stack.append((smaller, prefix))
        stack.append((part[key > pivot], prefix))
        if pivot > 0:
            count = int(n[equal].sum())
            if count >= least:
                phrase = (*prefix, int(pivot))
                found.append((phrase, count))
                if len(phrase) < len(words):
                    stack.append((equal, phrase))
    return found


def _frequent_phrases(longest: int, least: int, words_known: _Words):
    """The suffixes of a task to (phrase, n): whole counts of frequent phrases, and this task's share of those
    of phrases of very frequent words alone, which several tasks may hold."""
    hot = words_known.hot

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in source:
            lists = [column.flatten().to_numpy() for column in batch.columns[1:]]
            held.append((np.stack(lists[:-1]), lists[-1].astype(np.int64)))
        if not held:
            return
        words, n = np.concatenate([w for w, _ in held], axis=1), np.concatenate([n for _, n in held])
        del held
        shared: list[tuple[list[int], int]] = []
        among = np.cumprod([_among(w, hot) for w in words], axis=0).astype(bool)
        for d in range(1, longest - 1):  # phrases of d + 1 words
            rows = np.flatnonzero(among[d])
            if len(rows):
                phrases, at = np.unique(words[: d + 1, rows], axis=1, return_inverse=True)
                sums = np.bincount(at.reshape(-1), n[rows]).astype(np.int64)
                shared += zip(phrases.T.tolist(), sums.tolist())
        hot_words = set(hot.tolist())
        whole = [
            (phrase, count)
            for phrase, count in quicksort_counts(words, n, least)
            if len(phrase) > 1 and (len(phrase) == longest or not hot_words.issuperset(phrase))
        ]
        rows = [*whole, *shared]
        for a in range(0, len(rows), 100_000):
            part = rows[a : a + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([words_known.codes(list(p)).tolist() if words_known.all_known else list(p) for p, _ in part], pa.list_(pa.int64())), pa.array([c for _, c in part], pa.int64())],
                ["phrase", "n"],
            )

    return batches


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, task_pointers: int = TASK_POINTERS,
                     max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """Tables ``words`` (lang, word, code, f, n) and ``phrases`` (phrase as codes, f), both of at least ``least`` occurrences.

    ``phrases`` has one to ``longest`` words; ``n`` counts all words of the language.
    """
    spark = docs.sparkSession
    texts = docs.where(F.col("text").isNotNull()).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counted = texts.mapInArrow(_counts, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    counted = written(counted, "phrase_words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    code = F.udf(lambda lang, word: _code(lang, word.encode()), "bigint", useArrow=True)
    words = counted.where(F.col("f") >= least).join(totals, "lang").select("lang", "word", code("lang", "word").alias("code"), "f", "n")
    words = written(words, "phrase_frequent_words")
    everything = int(counted.agg(F.sum("f")).head()[0] or 0)
    # a word is very frequent if it fills a good part of a task: there are at most 8 * tasks of them
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-everything // task_pointers))
    bound = max(min(task_pointers, everything // tasks) // 8, least)
    all_known = words.count() <= max_words
    n_hot = words.where(F.col("f") >= bound).count()
    sent = words.where(F.col("f") >= (least if all_known else bound)).orderBy(F.desc("f"), "code").select("code")
    known = _Words([r[0] for r in sent.collect()], n_hot, all_known)
    lists = ", ".join(f"w{d + 1} array<{known.type[1]}>" for d in range(longest))
    suffixes = texts.mapInArrow(_suffixes(longest, known, tasks), f"route int, {lists}, n array<int>")
    dealt = suffixes.repartitionById(tasks, "route")
    found = dealt.mapInArrow(_frequent_phrases(longest, least, known), "phrase array<bigint>, n bigint")
    found = found.groupBy("phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    single = words.select(F.array("code").alias("phrase"), "f")
    return words, written(found.unionByName(single), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words.

    Words are those between spaces and tabs of the pieces between ``.,;:!?`` and line ends, A-Z lower-cased. A phrase with
    at least ``least`` occurrences (overlapping ones included) is scored at its weakest cut, floor(1000 a n / (l r)), where l
    and r count the two parts and n all words of the language; of equal cuts the first counts. Phrases inside a longer
    one that occurs as often are dropped. Ranks go by score, then a (both falling), then phrase in byte order.

    Null texts have no words, a null language is ``und``; null ids, repeated rows and empty texts need no special case, very
    long texts are handled by batch, and an empty table gives no rows. Other columns are ignored. Words are told apart by
    63-bit hashes. Counts are exact; products are decimals of 38 digits.
    """
    words, phrases = frequent_phrases(docs, least, longest, **options)
    size = F.size("phrase")
    several = phrases.where(size > 1).select("phrase", F.col("f").alias("a"))
    inside = several.where(size > 2).select(
        F.explode(F.array(F.slice("phrase", F.lit(1), size - 1), F.slice("phrase", F.lit(2), size - 1))).alias("phrase"), "a"
    )
    # a longer phrase that occurs as often has a part, one word longer than this one, that does so too
    covered = inside.groupBy("phrase").agg(F.max("a").alias("longer"))
    kept = several.join(covered, "phrase", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).select("phrase", "a")
    cuts = kept.select("phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "phrase", "a", "k",
        F.slice("phrase", F.lit(1), F.col("k")).alias("first"),
        F.slice("phrase", F.col("k") + 1, size - F.col("k")).alias("rest"),
    )
    parts = lambda name, f: phrases.select(F.col("phrase").alias(name), F.col("f").alias(f))
    wide = "decimal(19,0)"
    cut = cuts.join(parts("first", "l"), "first").join(parts("rest", "r"), "rest").join(
        words.select(F.col("code").alias("_code"), "n"), F.col("phrase")[0] == F.col("_code")
    )
    score = F.expr(f"cast(cast(1000 * cast(a as {wide}) as {wide}) * cast(n as {wide}) as decimal(38,0)) div (cast(l as {wide}) * cast(r as {wide}))")
    scored = cut.withColumn("score", score).groupBy("phrase").agg(
        F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("best")
    )
    scored = written(scored.select("phrase", "best.*"), "phrase_scores")
    spelled = (
        scored.select("phrase", F.posexplode("phrase").alias("nr", "code"))
        .join(words.select("code", "lang", "word"), "code")
        .groupBy("phrase")
        .agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("nr", "word"))).alias("spelled"))
        .select("phrase", "lang", F.array_join("spelled.word", " ").alias("text"))
    )
    listed = scored.join(spelled, "phrase").select("lang", F.col("text").alias("phrase"), "a", "l", "r", "n", "score")
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return listed.withColumn("rank", place).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
