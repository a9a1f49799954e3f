"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The index holds a posting (document, position, term) for every training token whose term occurs
in the benchmark; other tokens can't be part of a match. A window is 13 consecutive words of an
item, or all words of a shorter one. For each window the postings of its rarest terms, shifted
by their place in the item, are intersected; alignments that survive are checked at every place
of the item, and runs of matching places as long as a window are the exact phrase matches.

What is broadcast: the benchmark's terms and windows if their written files are small, else the
joins shuffle; and a filter of at most FILTER_BUCKETS numbers. Frequent terms cost a row for
each posting, never a pair of postings.

Defined results: null texts have no words. Repeated documents each get a row with the same
figures. Item rows repeated with one id count as one item. Documents with a null id are told
apart by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rankloom.llm.common import ascii_lower, broadcast_if_small, written

WINDOW, RAREST, RATIO = 13, 3, 20
#: Words of a text whose letters A-Z aren't lower-cased yet are what stands between these.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_BYTES, FILTER_BUCKETS = 16 << 20, 1 << 18
_NO_ID = -(1 << 63)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN_WORDS), "")


def document_key(id_col: Column, text: Column) -> list[Column]:
    """Columns k and h, equal only for repeated rows."""
    return [F.coalesce(id_col.cast("long"), F.lit(_NO_ID)).alias("k"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h")]


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(iid, item_id, n, place, term) for each word of each item."""
    rows = items.select(F.col(id_col).alias("item_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).distinct()
    rows = rows.select(F.xxhash64("item_id", "t").alias("iid"), "item_id", words(F.col("t")).alias("w"))
    return rows.select("iid", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("place", "term"))


def vocabulary(terms: DataFrame) -> DataFrame:
    """(term, key, tid) of the benchmark, and the empty term that ends each document's postings."""
    end = terms.sparkSession.range(1).select(F.lit("").alias("term"))
    found = terms.select("term").union(end).distinct()
    return written(found.select("term", F.lower("term").alias("key"), F.monotonically_increasing_id().alias("tid")), "terms")


def postings(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, h, pos, tid), written as they are read; the end's posting has the word count as position.

    Terms meet on their Unicode lower case, which is quick, and then must equal in A-Z only: if both
    are ASCII they do, while a Kelvin sign and a k have one lower case and are different words.
    """
    text = F.col(text_col)
    tokens = docs.select(*document_key(F.col(id_col), text), F.posexplode(F.concat(words(text), F.array(F.lit("")))).alias("pos", "word"))
    ascii_only = lambda c: F.char_length(c) == F.octet_length(c)
    same = F.when(ascii_only("word") & ascii_only("term"), F.lit(True)).otherwise(ascii_lower(F.col("word")) == F.col("term"))
    met = tokens.withColumn("key", F.lower("word")).join(broadcast_if_small(vocab, BROADCAST_BYTES), "key")
    return written(met.where(same).select("k", "h", "pos", "tid"), "postings")


def windows(terms: DataFrame, index: DataFrame, vocab: DataFrame, rarest: int = RAREST) -> tuple[DataFrame, DataFrame]:
    """The items' places (iid, item_id, n, place, tid) and, for windows whose terms all occur,
    (iid, start, rare: the places of its rarest terms)."""
    counts = index.groupBy("tid").agg(F.count("*").alias("df"))
    known = terms.join(vocab.select("term", "tid"), "term").join(counts, "tid", "left")
    places = written(known.select("iid", "item_id", "n", "place", "tid", F.coalesce("df", F.lit(0)).alias("df")), "places")
    first, last = F.greatest(F.lit(0), F.col("place") - (WINDOW - 1)), F.least(F.col("place"), F.greatest(F.lit(0), F.col("n") - WINDOW))
    inside = places.where(first <= last).select("iid", "place", "df", F.explode(F.sequence(first, last)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("iid", "start").orderBy("df", "place"))
    ranked = inside.withColumn("rank", rank).groupBy("iid", "start").agg(F.min("df").alias("least"), F.collect_list(F.when(F.col("rank") <= rarest, F.col("place"))).alias("rare"))
    return places, written(ranked.where("least > 0").select("iid", "start", "rare"), "windows")


def alignments(index: DataFrame, places: DataFrame, found: DataFrame) -> DataFrame:
    """(k, h, iid, shift) where the rarest terms of some window all stand at their places."""
    rare = found.select("iid", F.explode("rare").alias("place")).distinct().join(places.select("iid", "place", "tid").distinct(), ["iid", "place"])
    rare = written(rare, "rare")
    shifted = index.join(broadcast_if_small(rare, BROADCAST_BYTES), "tid").select("k", "h", "iid", (F.col("pos") - F.col("place")).alias("shift"), "place")
    met = shifted.groupBy("k", "h", "iid", "shift").agg(F.collect_set("place").alias("met"))
    sets = written(found.groupBy("iid").agg(F.collect_set("rare").alias("sets")), "sets")
    whole = F.exists("sets", lambda s: F.size(F.array_except(s, F.col("met"))) == 0)
    return written(met.join(broadcast_if_small(sets, BROADCAST_BYTES), "iid").where(whole).select("k", "h", "iid", "shift"), "alignments")


def matched_places(index: DataFrame, places: DataFrame, aligned: DataFrame, slop: int = 0) -> DataFrame:
    """(k, h, iid, item_id, n, shift, place, pos) where the item's term at ``place`` stands within
    ``slop`` of its place in the document."""
    bucket = F.pmod("h", F.lit(FILTER_BUCKETS))
    index = index.join(F.broadcast(aligned.select(bucket.alias("bucket")).distinct()), bucket == F.col("bucket"), "left_semi")
    wanted = aligned.join(broadcast_if_small(places.select("iid", "item_id", "n", "place", "tid"), BROADCAST_BYTES), "iid")
    offset = F.explode(F.sequence(F.lit(-slop), F.lit(slop))) if slop else F.lit(0)
    wanted = wanted.select("*", offset.alias("off")).withColumn("pos", F.col("shift") + F.col("place") + F.col("off")).drop("off")
    return wanted.join(index.distinct(), ["k", "h", "pos", "tid"])


def phrase_matches(index: DataFrame, places: DataFrame, found: DataFrame) -> DataFrame:
    """Exact matches (k, h, item_id, first, last): document positions of runs as long as a window or longer."""
    met = matched_places(index, places, alignments(index, places, found))
    group = ["k", "h", "iid", "shift"]
    run = F.col("place") - F.row_number().over(Window.partitionBy(*group).orderBy("place"))
    runs = met.withColumn("run", run).groupBy(*group, "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("item_id").alias("item_id"), F.first("n").alias("n"))
    return runs.where(F.col("last") - F.col("first") + 1 >= F.least(F.col("n"), F.lit(WINDOW))).select("k", "h", "item_id", "first", "last")


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int) -> DataFrame:
    """(doc_id, item_id, start): windows of which every term stands within ``slop`` words of its
    place, counted from an occurrence of the window's rarest term."""
    terms = item_terms(items)
    vocab = vocabulary(terms)
    index = postings(docs, vocab)
    places, found = windows(terms, index, vocab, rarest=1)
    aligned = alignments(index, places, found)
    met = matched_places(index, places, aligned, slop).select("k", "h", "iid", "item_id", "shift", "place", "n").distinct()
    at = met.join(found.select("iid", "start"), "iid").where("place >= start").where(F.col("place") < F.col("start") + WINDOW)
    whole = at.groupBy("k", "h", "iid", "item_id", "shift", "start", "n").agg(F.count("*").alias("c")).where(F.col("c") == F.least(F.col("n"), F.lit(WINDOW)))
    return whole.select(F.nullif("k", F.lit(_NO_ID)).alias("doc_id"), "item_id", "start").distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, and its key k, h."""
    terms = item_terms(items)
    vocab = vocabulary(terms)
    index = postings(docs, vocab, id_col, text_col)
    end = vocab.where("term = ''").first()["tid"]
    matches = written(phrase_matches(index.where(F.col("tid") != end), *windows(terms, index, vocab)), "matches")
    hit = matches.select("k", "h", F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy("k", "h").agg(F.count("*").alias("n_hit"))
    by_item = matches.select("k", "h", F.col("item_id").cast("string").alias("item")).groupBy("k", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = hit.join(by_item, ["k", "h"])
    rows = index.where(F.col("tid") == end).select("k", "h", F.col("pos").cast("long").alias("n_words")).join(found, ["k", "h"], "left")
    n_hit, own = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast(T.ArrayType(T.StringType())))
    rows = rows.select("k", "h", F.nullif("k", F.lit(_NO_ID)).alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(own).cast("long").alias("n_items"), F.sha2(F.array_join(own, ","), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (RATIO * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that aren't contaminated."""
    bad = contamination(docs, items, id_col, text_col).where("contaminated").select(F.col("k").alias("__k"), F.col("h").alias("__h"))
    key = document_key(F.col(id_col), F.col(text_col))
    return docs.join(bad, (key[0] == F.col("__k")) & (key[1] == F.col("__h")), "left_anti")
