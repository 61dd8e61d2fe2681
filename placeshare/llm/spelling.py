"""Spelling variants of frequent words, by search schemes on FM-indexes of the delimited vocabulary.

Two words are near if one code point inserted, deleted or replaced makes one into the other. Cut the
shorter one in halves: the change leaves one half as it is. So there are two searches: the first
matches ``|`` and the first half exactly and extends to the right, the second matches the last half
and ``|`` exactly and extends to the left, each across the rest with one error at most. The index
has both directions: the one that extends to the right is the FM-index of the reversed vocabulary
``|w1|w2|...|``, the one that extends to the left that of the vocabulary itself. A prefix that is
matched is an interval of suffix ranks, each step is two rank queries, and the words of an interval
of at most ``NARROW`` ranks are read from the text and compared. Neither search turns round, so no
search needs the intervals of both directions at once.

Words are dealt to shards by the half that must match, once for each search, so a word meets only
those that agree with it in one half; each shard has the index of its direction over its own words. A
half that more than ``SHARD`` words share is dealt as tiles of words searched and words indexed, so no
task holds more than some ``SHARD`` of each, whatever the vocabulary. The words searched go through a
tile's index in portions, of which a step tries some ``TRIED`` signs, so what a task holds beside the
index does not grow with the tile. A pair is found by the first search if its first halves agree, else
by the second, so each is found once.

Words are counted over all documents before anything is shuffled. Null texts have no words, texts
without letters neither; a null doc_id counts as the empty text in the crc32. Repeated rows count
as often as they are there, other columns are ignored, an empty table gives an empty result. Words of
any length take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeshare.llm.common import runs, stored

SHARD = 50_000
NARROW = 8
CELLS = 1 << 19
TRIED = 1 << 18
END = 1  # the sign between words; 0 ends the text


def frequent_words(docs: DataFrame, shortest: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """``word``, ``n``: the words of at least ``shortest`` code points that occur ``least`` times.

    A word is a run of letters with A-Z lower-cased; where ``every`` divides the crc32 of its document
    and itself, it loses the code point that the crc32 names.
    """
    upper, lower = (bytes(range(a, a + 26)).decode() for a in (65, 97))
    found = F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{shortest},}}"), F.lit(0)))
    run = F.when(F.col("found").rlike("[A-Z]"), F.translate("found", upper, lower)).otherwise(F.col("found"))
    h = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(
        F.substr("run", F.lit(1), at), F.substr("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return (
        docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), found.alias("found"))
        .select("id", run.alias("run")).select("run", h.alias("h")).select(word.alias("word"))
        .where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    )


class Index:
    """An FM-index of words, given as the codes of all (2 or more) and their lengths, extended to the right.

    It is that of the reversed text, so each step takes a pattern's next sign. Signs are sorted with
    their places in one array: the rank of a place among those of a sign is a binary search.
    """

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        words = len(lengths)
        ends = np.cumsum(lengths + 1)
        text = np.full(int(ends[-1]) + 1 if words else 1, END, dtype=np.int64)
        inside = np.ones(len(text), dtype=bool)
        inside[0] = False
        inside[ends] = False
        text[inside] = flat
        self.text = np.concatenate([text[::-1], [0]])  # reversed: |nw|...|2w|1w| and the end
        self.size = len(self.text)
        owner = np.repeat(np.arange(words), lengths + 1)
        # the word after each sign of the text; the last | has none
        self.owner = np.concatenate([np.append(owner, -1)[::-1], [-1]])
        self.order = self._sorted(int(lengths.max(initial=0)) + 2)
        signs = self.text[self.order - 1]
        by_sign = np.argsort(signs, kind="stable")
        self.keys = signs[by_sign] * (self.size + 1) + by_sign
        self.letters = np.unique(flat)

    def _sorted(self, depth: int) -> np.ndarray:
        """The order of all suffixes by their first ``depth`` signs at least, by prefix doubling."""
        bits = int(self.text.max()).bit_length()
        known = max(1, 62 // bits)
        key = np.zeros(self.size, dtype=np.int64)
        padded = np.concatenate([self.text, np.zeros(known, dtype=np.int64)])
        for k in range(known):
            key = (key << bits) | padded[k: k + self.size]
        while True:
            order = np.argsort(key, kind="stable")
            change = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
            if known >= depth or change[-1] == self.size - 1:
                return order
            rank = np.empty(self.size, dtype=np.int64)
            rank[order] = change + 1
            after = np.zeros(self.size, dtype=np.int64)
            after[: self.size - known] = rank[known:]
            key = rank * (self.size + 2) + after
            known *= 2

    def step(self, low: np.ndarray, high: np.ndarray, sign: np.ndarray):
        """The intervals of patterns that go on with ``sign``."""
        base = sign * (self.size + 1)
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def words(self, ranks: np.ndarray, before: int = 0) -> np.ndarray:
        """The words in which the suffixes of these ranks begin, or ``before`` signs before them.

        Suffixes of the reversed text begin with the sign matched last.
        """
        return self.owner[self.order[ranks] + before]


def _candidates(index: Index, flat: np.ndarray, start: np.ndarray, length: np.ndarray, half: np.ndarray):
    """Pairs (query, word) among which all words within one error behind the first ``half`` signs are."""
    low, high = index.step(np.zeros(len(start), np.int64), np.full(len(start), index.size), np.full(len(start), END))
    q, at, error = np.arange(len(start)), np.zeros(len(start), np.int64), np.zeros(len(start), bool)
    while len(q):
        narrow = high - low <= NARROW
        width = (high - low)[narrow]
        if width.sum():
            first = np.repeat(low[narrow] - np.concatenate([[0], np.cumsum(width)[:-1]]), width)
            yield np.repeat(q[narrow], width), index.words(first + np.arange(width.sum()))
        q, at, error, low, high = (x[~narrow] for x in (q, at, error, low, high))
        inside = at < length[q]
        sign = np.where(inside, flat[np.minimum(start[q] + at, len(flat) - 1)], END)
        a, b = index.step(low, high, sign)
        whole = error & ~inside & (b > a)  # one word, and its | is matched, too
        if whole.any():
            yield q[whole], index.words(a[whole], 1)
        grown = [(q[inside], at[inside] + 1, error[inside], a[inside], b[inside])]
        free = np.flatnonzero(~error & (at >= half[q]))
        if len(free):
            gone = free[inside[free]]
            grown.append((q[gone], at[gone] + 1, np.ones(len(gone), bool), low[gone], high[gone]))
            each = np.repeat(free, len(index.letters))
            letter = np.tile(index.letters, len(free))
            a, b = index.step(low[each], high[each], letter)
            some = b > a
            each, a, b, letter = each[some], a[some], b[some], letter[some]
            true = np.ones(len(each), bool)
            grown.append((q[each], at[each], true, a, b))
            other = inside[each] & (letter != sign[each])
            grown.append((q[each][other], at[each][other] + 1, true[other], a[other], b[other]))
        q, at, error, low, high = (np.concatenate(x) for x in zip(*grown))
        some = high > low
        q, at, error, low, high = (x[some] for x in (q, at, error, low, high))


def _matrix(flat: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, fill: int, back: bool) -> np.ndarray:
    """Words as rows, from their first sign on, or from their last one back."""
    place = np.arange(width)
    at = start[:, None] + (length[:, None] - 1 - place if back else place)
    return np.where(place < length[:, None], flat[np.clip(at, 0, max(len(flat) - 1, 0))], fill)


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many signs two matrices' rows share from the left; they differ somewhere."""
    return (x != y).argmax(axis=1)


def _near(flat, start, length, tflat, tstart, tlength, q, t):
    """Of pairs (q, t) those that differ by exactly one sign, and the signs that they share from the left."""
    fits = np.abs(length[q] - tlength[t]) <= 1
    q, t = q[fits], t[fits]
    order = np.argsort(np.maximum(length[q], tlength[t]), kind="stable")
    q, t = q[order], t[order]
    longest = np.maximum(length[q], tlength[t])
    first = 0
    while first < len(q):
        last = first + 1
        most = max(1, CELLS // (int(longest[first]) + 1))
        last = min(len(q), first + most)
        while last > first + 1 and (last - first) * (int(longest[last - 1]) + 1) > 2 * CELLS:
            last = first + (last - first) // 2
        a, b = q[first:last], t[first:last]
        width = int(longest[last - 1]) + 1
        left, right = (
            _shared(_matrix(flat, start[a], length[a], width, -1, back), _matrix(tflat, tstart[b], tlength[b], width, -2, back))
            for back in (False, True)
        )
        # equal words share all signs before the fills, which differ
        good = (left + right >= longest[first:last] - 1) & (left < longest[first:last])
        yield a[good], b[good], left[good]
        first = last


def _coded(words: list[str], codes: dict[str, int]):
    """All words' codes in a row, where each begins, and their lengths."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    length = np.array([len(w) for w in words], dtype=np.int64)
    points = np.array(sorted(map(ord, codes)), dtype=np.uint32)
    values = np.array([codes[chr(p)] for p in points.tolist()], dtype=np.int64)
    coded = values[np.searchsorted(points, flat)] if len(points) else np.zeros(0, np.int64)
    return coded, np.concatenate([[0], np.cumsum(length)[:-1]]), length


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near words of each tile's queries."""
    for tile in runs(batches, ["side", "shard", "i", "j"]):
        back = bool(tile["side"][0].as_py())
        words, weight = tile["word"].to_pylist(), tile["n"].to_numpy()
        turned = [w[::-1] for w in words] if back else words
        indexed, asked = tile["indexed"].to_numpy(), np.flatnonzero(tile["asked"].to_numpy())
        known: dict[str, int] = {}
        for i in np.flatnonzero(indexed).tolist():
            known.setdefault(turned[i], i)
        if not known or not len(asked):
            continue
        codes = {c: k for k, c in enumerate(sorted(set("".join(turned))), END + 1)}
        tflat, tstart, tlength = _coded(list(known), codes)
        flat, start, length = _coded([turned[i] for i in asked.tolist()], codes)
        half, place = tile["half"].to_numpy()[asked], np.array(list(known.values()))
        index = Index(tflat, tlength)
        portion = max(1, TRIED // (len(index.letters) + 1))
        for first in range(0, len(asked), portion):
            some = slice(first, first + portion)
            found = list(_candidates(index, flat, start[some], length[some], half[some]))
            if not found:
                continue
            q, t = (np.concatenate(x) for x in zip(*found))
            pair = np.unique(((q + first) * len(known) + t)[t >= 0])  # no word begins with the last |
            q, t = pair // len(known), pair % len(known)
            for q, t, left in _near(flat, start, length, tflat, tstart, tlength, q, t):
                shorter = np.minimum(length[q], tlength[t])
                right = shorter // 2 == half[q]
                if back:  # the first search has those whose first halves agree
                    one, two = ([words[k] for k in x] for x in (asked[q].tolist(), place[t].tolist()))
                    agree = np.array([a[:h] == b[:h] for a, b, h in zip(one, two, (shorter // 2).tolist())], dtype=bool)
                    right &= ~agree
                else:
                    right &= left >= half[q]
                q, t = q[right], t[right]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words[k] for k in asked[q].tolist()], pa.string()),
                     pa.array([words[k] for k in place[t].tolist()], pa.string()), pa.array(weight[place[t]], pa.int64())],
                    names=["word", "near", "near_n"],
                )


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """``word``, ``near``, ``near_n``: each pair of near words, both ways round, from distinct words (``word``, ``n``)."""
    size = F.length("word")
    halves = F.array_distinct(F.transform(F.array(size, F.greatest(size - 1, F.lit(2))), lambda m: F.floor(m / 2).cast("int")))
    rows = stored(
        words.where(size > 1).select("word", "n", F.explode(halves).alias("half"))
        .select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
        .withColumn("piece", F.expr("if(side = 0, left(word, half), right(word, half))")), "halves",
    )
    group = ["side", "half", "piece"]
    large = rows.groupBy(*group).agg(F.count("*").alias("g")).where(F.col("g") > shard)
    shards = -(-rows.count() // (2 * shard)) or 1
    k, part = F.col("k"), F.col("part")
    role = lambda i, j, indexed, asked: F.struct(
        i.alias("i"), j.alias("j"), F.lit(indexed).alias("indexed"), F.lit(asked).alias("asked"))
    tiles = (
        rows.join(large, group, "left")
        .withColumn("parts", F.ceil(F.coalesce("g", F.lit(1)) / shard))
        .withColumn("shard", F.when(F.col("g").isNull(), F.expr(f"pmod(xxhash64(half, piece), {shards}L)")).otherwise(F.xxhash64(*group)))
        .withColumn("part", F.expr("pmod(xxhash64(word, 3), parts)"))
        .withColumn("k", F.explode(F.expr("sequence(0L, parts - 1)")))
        .withColumn("role", F.explode(F.when(k == part, F.array(role(part, k, True, True))).otherwise(
            F.array(role(part, k, True, False), role(k, part, False, True)))))
        .select("side", "shard", "role.*", "half", "word", "n")
        .repartition("side", "shard", "i", "j").sortWithinPartitions("side", "shard", "i", "j")
    )
    return tiles.mapInArrow(_pairs, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` from ``word``, ``form``: forms followed to the last, twice as far in each round.

    A form occurs at least ``times`` as often as its word, so chains grow with the logarithm of the rows.
    """
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        above = roots.select(F.col("word").alias("root"), F.col("root").alias("above"))
        moved = stored(roots.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), "above"), "roots")
        if not moved.where("above is not null").limit(1).count():
            return moved.select("word", "root")
        roots = moved.select("word", "root")


def spelling_variants(words: DataFrame, times: int = 5, shard: int = SHARD) -> DataFrame:
    """Each distinct word (``word``, ``n``) with ``form``, ``root``, ``n_near`` and ``form_n``.

    A word's form is its near word of largest n (ties: the smallest), if that is at least ``times``
    its own; the root is what forms lead to.
    """
    words = stored(words, "words")
    best = near_words(words, shard).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"),
    )
    form = F.expr(f"if(-best.less >= {times} * n, best.near, null)")
    result = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"),
        F.expr(f"if(-best.less >= {times} * n, -best.less, null)").alias("form_n"),
    ), "forms")
    roots = _roots(result.where("form is not null"))
    return result.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n",
    )
