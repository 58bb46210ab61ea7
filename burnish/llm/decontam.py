"""Benchmark decontamination by a prefix-filtered set join (operator 4), native.

A window is 13 consecutive words of an item (an item of fewer words is one window).
A window is taken as the set of its placed shingles of three words (all of them for
shorter windows). Containment of all of them is asked for, so the necessary prefix
is one shingle, the rarest:

1. The benchmark's words are counted over all documents. A shingle is as rare as its
   rarest word; of equals the one with fewer counts in all, then the first. A window with
   a word that no document has can't occur; of the others each is known by its rarest
   shingle, the prefix.
2. One pass over the documents, whatever the benchmark's size, keeps the places of these
   shingles with the words around them. Only keys of shingles are broadcast, up to KEYS
   of them; a larger benchmark's keys are joined by a shuffle.
3. Places meet the windows of their shingle. Length and positional bounds (the window must
   begin at or after the first word and end at or before the last) leave candidates.
4. A candidate holds if the words around its place are the window's: exact containment
   over a run of words of the window's length.

Only DataFrame functions are used. Defined results: null or empty texts and items have
no words; an item without an id takes part but isn't listed; items that repeat an id
count once; repeated documents have a row each; an empty benchmark hits nothing; a text
of any length is searched whole, and what is kept of it is its places; windows that tie
in rarity change the cost and not the result; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared

WINDOW = 13
GRAM = 3
#: At most so many keys are broadcast (about 50 MB).
KEYS = 2_000_000
#: The key of the row that each document has besides its places.
DOCUMENT = 0
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """item_id, window (its words, space-joined), len: a row for each distinct one."""
    held = items.select(items["item_id"].cast("string").alias("item_id"), words(items["text"]).alias("w")).where("size(w) > 0")
    starts = held.withColumn("s", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - length, F.lit(0)))))
    cut = starts.withColumn("w", F.slice("w", F.col("s") + 1, length))
    return cut.select("item_id", F.array_join("w", " ").alias("window"), F.size("w").alias("len")).distinct()


def bounded(df: DataFrame) -> DataFrame:
    """df, broadcast if it has few enough rows."""
    return F.broadcast(df) if df.count() <= KEYS else df


def _key(g: int, at) -> Column:
    return F.xxhash64(F.lit(g), *[at(k) for k in range(g)])


def prefixes(plain: DataFrame, held: DataFrame) -> DataFrame:
    """window, len, g, off, key: each distinct window that can occur, and its rarest
    shingle of g words, which begins off words after the window's first."""
    each = held.select("window", "len").distinct().select("window", "len", F.posexplode(F.split("window", " ")).alias("i", "word"))
    each = each.withColumn("word", F.xxhash64("word"))  # words of one hash change the cost and not the result
    vocabulary = _shared.written(each.select("word").distinct(), "vocabulary")
    every = plain.select(F.explode("w").alias("word")).select(F.xxhash64("word").alias("word"))
    seen = _shared.written(every.join(bounded(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("seen")), "seen")
    counted = each.join(bounded(seen), "word").groupBy("window", "len").agg(F.sort_array(F.collect_list(F.struct("i", "seen"))).alias("x"))  # a window's words
    counted = counted.where("size(x) = len").withColumn("g", F.least("len", F.lit(GRAM))).withColumn("n", F.expr("transform(x, y -> y.seen)"))
    rarest = F.expr("array_min(transform(sequence(0, len - g), o -> struct(array_min(slice(n, o + 1, g)) AS least, aggregate(slice(n, o + 1, g), 0L, (a, b) -> a + b) AS total, o AS off)))")
    chosen = counted.select("window", "len", "g", F.split("window", " ").alias("w"), rarest["off"].alias("off"))
    key = F.coalesce(*[F.when(F.col("g") == g, _key(g, lambda k: F.get("w", F.col("off") + k))) for g in range(1, GRAM + 1)])
    out = _shared.written(chosen.select("window", "len", "g", "off", key.alias("key")), "prefixes")
    _shared.discard(vocabulary)
    _shared.discard(seen)
    return out


def places(plain: DataFrame, rare: DataFrame, length: int) -> DataFrame:
    """row, doc_id, n_words, pos, key, low, context: where documents hold a key, with the
    words from place low on; and for each document a row with pos -1."""
    sizes = sorted(int(r["g"]) for r in rare.select("g").distinct().collect())  # 1, 2, 3 at most
    every = rare.sparkSession.range(DOCUMENT, DOCUMENT + 1).select(F.col("id").alias("key"))
    keys = rare.select("key").union(every).distinct()
    spread = plain.withColumn("n_words", F.size("w")).withColumn("pos", F.explode(F.sequence(F.lit(-1), F.col("n_words") - 1)))
    found = [F.when(F.col("pos") + g <= F.col("n_words"), _key(g, lambda k: F.get("w", F.col("pos") + k))) for g in sizes]
    if len(found) > 1:
        keyed = spread.select("*", F.posexplode(F.array(*found)).alias("kind", "at")).where("pos >= 0 or kind = 0")
    else:
        keyed = spread.withColumn("at", found[0] if found else F.lit(None).cast("long"))
    keyed = keyed.withColumn("key", F.when(F.col("pos") < 0, F.lit(DOCUMENT).cast("long")).otherwise(F.col("at"))).where("key is not null")
    low = F.greatest(F.col("pos") - (length - 1), F.lit(0))
    held = keyed.join(bounded(keys), "key", "left_semi")
    context = F.when(F.col("pos") >= 0, F.slice("w", low + 1, 2 * length + GRAM))
    return _shared.written(held.select("row", "doc_id", "n_words", "pos", "key", low.alias("low"), context.alias("context")), "places")


def occurrences(held: DataFrame, rare: DataFrame) -> DataFrame:
    """row, start, len, window: where windows occur."""
    met = held.where("pos >= 0").join(rare, "key").withColumn("start", F.col("pos") - F.col("off")).where("start >= 0 and start + len <= n_words")
    same = F.array_join(F.slice("context", F.col("start") - F.col("low") + 1, F.col("len")), " ") == F.col("window")
    return met.where(same).select("row", "start", "len", "window").distinct()


def contamination(docs: DataFrame, items: DataFrame, length: int = WINDOW, least_share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the words of the
    longest window that occurs (0: none), for each document."""
    _shared.prepare(docs.sparkSession)
    held_windows = _shared.written(windows(_shared.only(items, "item_id", "text"), length), "windows")
    given = _shared.only(docs, "doc_id", "text")
    plain = given.select("doc_id", words(F.col("text")).alias("w"), F.monotonically_increasing_id().alias("row"))
    rare = prefixes(plain, held_windows)
    held = places(plain, rare, length)
    found = _shared.written(occurrences(held, rare), "occurrences")
    longest = found.groupBy("row").agg(F.max("len").alias("longest"))
    hit = found.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    listed = found.select("row", "window").distinct().join(held_windows.where("item_id is not null").select("window", "item_id"), "window").select("row", "item_id").distinct()
    listed = listed.groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("items"))
    every = held.where("pos < 0").select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"))
    joined = every.join(hit, "row", "left").join(listed, "row", "left").join(longest, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (least_share * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("longest", F.lit(0)).alias("longest_window"),
    )


def uncontaminated(docs: DataFrame, items: DataFrame, length: int = WINDOW, least_share: int = 20) -> DataFrame:
    """docs without those that hold a whole window of `length` words, however long they
    are, or whose words are hit to one part in least_share. What is decided is decided
    for a doc_id with a text, so rows without or with a repeated doc_id are judged by
    their own texts."""
    inner, names = _shared.numbered(docs), docs.columns
    id_, text = F.col(f"c{_shared.place(names, 'doc_id')}"), F.col(f"c{_shared.place(names, 'text')}").cast("string")
    told = inner.select(F.struct(id_.alias("id"), F.xxhash64(text).alias("hash")).alias("doc_id"), text.alias("text"))
    found = contamination(told, items, length, least_share).where(F.col("contaminated") | (F.col("longest_window") >= length))
    gone = found.select(F.col("doc_id.id").alias("gone_id"), F.col("doc_id.hash").alias("gone_hash")).distinct()
    return inner.join(gone, id_.eqNullSafe(F.col("gone_id")) & (F.xxhash64(text) == F.col("gone_hash")), "left_anti").toDF(*names)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
v AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s + 1:s + 13], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 13, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM v),
p AS (
  SELECT doc_id, s, n, array_to_string(w[s + 1:s + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
o AS (SELECT doc_id, s, p.n, item_id FROM p JOIN v ON p.win = v.win),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM o) GROUP BY doc_id),
i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
