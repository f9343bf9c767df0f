"""Spelling variants: words one letter apart, each led to its most frequent neighbour, without listing pairs.

Words that differ by a replaced letter share a wildcard: the word with a gap at that letter. Words that differ by an
inserted letter share the shorter one: it is a word, and a deletion of the longer. Wildcards, deletions and the words
themselves are keys of one shuffle; a window over a key gives its size, its two most frequent words and the word that
the key itself is, from which each row knows how many neighbours it has there and the best other one. Summed by word,
that is the whole neighbourhood. A key has a word a letter of the alphabet and place at most, so none is hot.

Words are numbered by falling frequency and then by code points, so the best of some words is the least number; keys
are 128-bit hashes, made in time linear in a word's length. What moves is numbers alone, however long a word is.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, as_bytes, small_batches

#: Words of fewer code points, or found less often, are none.
LETTERS, TIMES = 7, 2
#: One run of a document in so many loses a letter.
DROP_EVERY = 31
#: A form is at least so many times as frequent as the word.
MORE = 10
#: Words that a task adds up before it passes them on.
KEEP_WORDS = 200_000
_GAP = "*"  # in no word
#: Kinds of keys.
WORD, GAP, SHORTER = 0, 1, 2


def _run_pattern(letters: int) -> re.Pattern[str]:
    return re.compile("[A-Za-zÀ-ÿ]{%d,}" % letters)


def _counted(letters: int, every: int):
    find = _run_pattern(letters).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in small_batches(batches, "text"):
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                if not raw:
                    continue
                start = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
                for word in find(raw.lower().decode()):  # lower() of bytes knows A-Z alone
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < letters:
                            continue
                    seen[word] = seen.get(word, 0) + 1
                if len(seen) >= KEEP_WORDS:
                    yield passed_on()
        if seen:
            yield passed_on()

    return run


def vocabulary(docs: DataFrame, letters: int = LETTERS, times: int = TIMES, every: int = DROP_EVERY) -> DataFrame:
    """(word, n) of the runs of letters in ``docs`` (doc_id, text), A-Z lower-cased, some with a letter dropped.

    Runs that drop one are those whose crc32 (``<doc_id>:<run>``; nothing before the colon where doc_id is null) divides
    by ``every``. Null and empty texts have no runs; repeated rows count again.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counted(letters, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def _mix(letters: np.ndarray, places: np.ndarray, lane: int) -> np.ndarray:
    """A 64-bit hash of each letter at its place."""
    x = letters.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (places.astype(np.uint64) + np.uint64(lane << 40)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x2545F4914F6CDD1D)
    return x ^ (x >> np.uint64(31))


def word_keys(words: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, kind, key of two 64-bit lanes) of the words, their wildcards and distinct deletions of ``least`` letters or more.

    A key is the sum of hashes of letters at their places, so all keys of a word take time linear in its length.
    """
    sizes = np.array([len(w) for w in words])
    ends = np.cumsum(sizes)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    of = np.repeat(np.arange(len(words)), sizes)
    places = np.arange(len(letters)) - (ends - sizes)[of]
    # of equal letters in a row the last stands for all: without any of them the word is the same
    cut = np.ones(len(letters), bool)
    cut[:-1] = (letters[:-1] != letters[1:]) | (of[:-1] != of[1:])
    cut &= sizes[of] > least
    lanes = []
    for lane in (0, 1):
        here, moved = _mix(letters, places, lane), _mix(letters, places - 1, lane)
        before, after = np.cumsum(here), np.cumsum(moved)  # modulo 2**64
        start = np.where(ends > sizes, before[ends - sizes - 1], np.uint64(0)) if len(before) else np.zeros(len(words), np.uint64)
        whole = before[ends - 1] - start
        gap = _mix(np.full(len(letters), ord(_GAP)), places, lane)
        shorter = (before - here - start[of])[cut] + (after[ends - 1][of] - after)[cut]
        lanes.append(np.concatenate([whole, whole[of] - here + gap, shorter]))
    kinds = np.repeat([WORD, GAP, SHORTER], [len(words), len(letters), int(cut.sum())]).astype(np.int8)
    return np.concatenate([np.arange(len(words)), of, of[cut]]), kinds, np.stack(lanes).view(np.int64)


def _keyed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches((b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)), "word", 1 << 16):
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            at, kinds, keys = word_keys(batch.column("word").to_pylist(), least)
            for s in range(0, len(at), 100_000):
                part = slice(s, s + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[0, part]), pa.array(keys[1, part]), pa.array(kinds[part]), pa.array(ids[at[part]])], ["k0", "k1", "kind", "id"])

    return run


def ranked(counts: DataFrame, work: Workspace) -> DataFrame:
    """``counts`` (word, n) with id: of two words that of larger n, or the first in code-point order, has the smaller one."""
    order = [F.col("n").desc(), F.col("word")]
    return work.table(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "words")


def neighbourhoods(words: DataFrame, least: int = LETTERS) -> DataFrame:
    """(id, n_near, best) of each row of ``words`` (id, word; each word once): how many are one letter apart, and the least id of these.

    ``least`` is the fewest letters that a word has, so shorter deletions meet nothing and are not made. Words of any
    length take time and rows in proportion to it.
    """
    rows = words.select("id", "word").mapInArrow(_keyed(least), "k0 long, k1 long, kind byte, id long")
    by_rank = Window.partitionBy("k0", "k1").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "kind",
        "id",
        F.count("*").over(by_rank).alias("size"),
        F.first("id").over(by_rank).alias("one"),
        F.nth_value("id", 2).over(by_rank).alias("two"),
        F.min(F.when(F.col("kind") == WORD, F.col("id"))).over(by_rank).alias("itself"),
    )
    longer = F.col("kind") == SHORTER  # the key is another word, if any, and this row's word is longer than it
    rows = rows.filter((F.col("kind") == WORD) | (F.col("size") > 1) & (~longer | F.col("itself").isNotNull()))
    other = F.when(F.col("one") == F.col("id"), F.col("two")).otherwise(F.col("one"))
    rows = rows.select("id", F.when(longer, 1).otherwise(F.col("size") - 1).alias("c"), F.when(longer, F.col("itself")).otherwise(other).alias("best"))
    return rows.groupBy("id").agg(F.sum("c").cast("long").alias("n_near"), F.min("best").alias("best"))


def lead_to_roots(forms: DataFrame, most: int, work: Workspace) -> DataFrame:
    """(id, root) for ``forms`` (id, form), whose forms are each MORE times as frequent, the largest ``most`` times.

    Roots jump to roots of roots, so chains of d links take log2(d) rounds; d follows from ``most``.
    """
    links = max(1, math.floor(math.log(max(most, 2), MORE)) + 1)
    now = work.table(forms.select("id", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(links)) if links > 1 else 0):
        onward = now.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        now = work.table(now.join(onward, F.col("root") == F.col("_id"), "left").select("id", F.coalesce("_root", "root").alias("root")), "roots")
    return now


def variants(docs: DataFrame, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of ``docs`` (doc_id, text; other columns are ignored).

    A word's form is its best neighbour, if that is at least MORE times as frequent, else null; its root is where forms
    lead in the end, itself without a form. Null texts have no words, repeated rows count again, no words give an empty
    table. Whole texts are read, of any length; words are added up before they move, and only numbers move after that.
    """
    work = Workspace(docs.sparkSession, "spelling")
    words = ranked(vocabulary(docs, letters, times), work)
    near = words.join(neighbourhoods(words, letters), "id")
    better = words.select(F.col("id").alias("best"), F.col("word").alias("_word"), F.col("n").alias("_n"))
    formed = F.coalesce(F.col("_n") >= MORE * F.col("n"), F.lit(False))
    kept = {"form_id": "best", "form": "_word", "form_n": "_n"}
    near = near.join(better, "best", "left").select("id", "word", "n", "n_near", *[F.when(formed, F.col(v)).alias(k) for k, v in kept.items()])
    near = work.table(near, "near")
    most = near.agg(F.max("form_n")).first()[0] or 0
    roots = lead_to_roots(near.filter("form_id is not null").select("id", F.col("form_id").alias("form")), most, work)
    roots = roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("_root")), "root").select("id", "_root")
    return near.join(roots, "id", "left").select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")


#: The same rows with pairs of words listed, which SQL has to.
ORACLE_SQL = f"""WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS w FROM documents),
kinds AS (SELECT doc_id, w, count(*) AS c FROM runs WHERE length(w) >= {LETTERS} GROUP BY ALL),
bytes AS (SELECT *, list_transform(range(octet_length(encode(doc_id || ':' || w))), lambda k: ('0x' || substring(hex(encode(doc_id || ':' || w)), 2 * k + 1, 2))::BIGINT) AS codes FROM kinds),
hashed AS (SELECT w, c, xor(list_reduce(list_prepend(4294967295, codes), lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda d, k: xor(d >> 1, (d & 1) * 3988292384))), 4294967295) AS h FROM bytes),
words AS (SELECT CASE WHEN h % {DROP_EVERY} = 0 THEN substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word, sum(c)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= {LETTERS} AND sum(c) >= {TIMES}),
gaps AS (SELECT word, n, unnest(list_transform(range(length(word)), lambda k: substring(word, 1, k) || '*' || substring(word, k + 2))) AS key FROM words),
cuts AS (SELECT DISTINCT word, n, unnest(list_transform(range(length(word)), lambda k: substring(word, 1, k) || substring(word, k + 2))) AS key FROM words),
pairs AS (SELECT a.word, a.n, b.word AS near, b.n AS m FROM gaps a JOIN gaps b ON a.key = b.key AND a.word <> b.word
  UNION ALL SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.key = b.word
  UNION ALL SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.key = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min({{'near': near, 'm': m}}, {{'o': -m, 'near': near}}) AS b FROM pairs GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.m >= {MORE} * w.n THEN b.near END AS form, CASE WHEN b.m >= {MORE} * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best USING (word)),
RECURSIVE_ROOTS
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots r ON r.word = f.word"""
_ROOTS = """led AS (SELECT word, word AS root, form AS onward FROM formed UNION ALL SELECT l.word, f.word, f.form FROM led l JOIN formed f ON f.word = l.onward),
roots AS (SELECT word, root FROM led WHERE onward IS NULL)"""
ORACLE_SQL = ORACLE_SQL.replace("WITH runs", "WITH RECURSIVE runs").replace("RECURSIVE_ROOTS", _ROOTS)
