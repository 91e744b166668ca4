"""Benchmark decontamination: a broadcast hash set of the items' word windows, probed by every window of the documents.

Only DataFrame functions: a document's words are one array, its positions are exploded and hashed in generated code, probed against the
set and, where a hash is known, compared word by word. Only hits are shuffled, to their document.

The set is broadcast while it has at most ``MAX_BROADCAST`` windows (it is counted first). A larger one is joined by a shuffle of the
windows' hashes alone; the hits are then brought to their documents' words and verified there.

Windows are ``WINDOW`` words; an item of fewer words is one window, one of none is never found. Null and empty texts have no words; null
doc_ids and repeated rows are documents like others; windows of items without an id count, the items do not; items of the same text all count; extra columns are
kept by ``remove_spans`` and ``drop_contaminated`` and ignored elsewhere; without items or documents nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lintlake.llm.frames import fresh, row_key
from lintlake.llm.terms import words

WINDOW, MAX_BROADCAST = 10, 2_000_000
#: Characters between words, as a class of Java's and DuckDB's patterns.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: The same in a text that is not in lower case, without the brackets.
_BETWEEN_ANY = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def _gram(all_words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(all_words, start + 1, length), " ")


def _hash(all_words: Column, start: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(all_words, start + k) for k in range(size)])


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(hash, size, gram, item_id): distinct windows of each item."""
    read = items.select("item_id", words(F.col("text"), BETWEEN).alias("words")).filter("size(words) > 0")
    sized = read.withColumn("size", F.least(F.size("words"), F.lit(window)))
    starts = sized.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))))
    return starts.select(_hashes("words", window).alias("hash"), "size", _gram(F.col("words"), F.col("start"), F.col("size")).alias("gram"), "item_id").distinct()


def _hashes(name: str, window: int) -> Column:
    """The hash of the window of ``size`` words at ``start``."""
    found = _hash(F.col(name), F.col("start"), window)
    for size in range(1, window):
        found = F.when(F.col("size") == size, _hash(F.col(name), F.col("start"), size)).otherwise(found)
    return found


def _positions(docs: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """(id, row, words, start, size, hash) of every document window of one of the sizes."""
    read = docs.select(F.col("doc_id").alias("id"), row_key().alias("row"), words(F.col("text"), BETWEEN).alias("words"))
    last = F.size("words") - min(sizes)
    starts = read.withColumn("start", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))
    if len(sizes) == 1:
        sized = starts.withColumn("size", F.lit(sizes[0]))
        return sized.withColumn("hash", _hash(F.col("words"), F.col("start"), sizes[0]))
    sized = starts.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).filter("start + size <= size(words)")
    return sized.withColumn("hash", _hashes("words", window))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(id, row, start, size, item_ids): the places where a window of some item stands; ``row`` tells documents of one id apart."""
    keys = ["hash", "size", "gram"]
    grams = item_windows(items, window).groupBy(*keys).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    count = grams.agg(F.count("*").alias("n"), F.collect_set("size").alias("sizes")).first()
    sizes = sorted(count["sizes"]) or [window]  # at most ``window`` of them
    known = grams.withColumnsRenamed({"size": "known_size", "hash": "known"})
    same = (F.col("hash") == F.col("known")) & (F.col("size") == F.col("known_size"))
    verified = F.col("gram") == _gram(F.col("words"), F.col("start"), F.col("size"))
    windows = _positions(docs, sizes, window)
    if count["n"] <= max_broadcast:
        found = windows.join(F.broadcast(known), same & verified)
    else:
        places = windows.select("id", "row", "start", "size", "hash").join(known, same)
        texts = docs.select(F.col("doc_id").alias("id"), row_key().alias("row"), words(F.col("text"), BETWEEN).alias("words")).distinct()
        found = places.withColumnsRenamed({"id": "at_id", "row": "at_row"}).join(
            texts, F.expr("at_id <=> id and at_row = row")).filter(verified)
    return found.select("id", "row", "start", "size", "item_ids").dropDuplicates(["id", "row", "start", "size"])


def contaminated_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(id, row, spans, item_ids) of the documents that hold some window: disjoint spans of words in order, and the items in order."""
    end = F.col("start") + F.col("size")
    by_start = W.partitionBy("id", "row").orderBy("start", "size")
    before = F.max(end).over(by_start.rowsBetween(W.unboundedPreceding, -1))
    opens = hits(docs, items, window, max_broadcast).withColumn("opens", F.when(F.col("start") <= before, 0).otherwise(1))
    numbered = opens.withColumn("span", F.sum("opens").over(by_start.rowsBetween(W.unboundedPreceding, 0)))
    # windows of a span that share their items give the list once
    spans = numbered.groupBy("id", "row", "span").agg(F.min("start").alias("from"), F.max(end).alias("to"), F.collect_set("item_ids").alias("lists"))
    whole = spans.groupBy("id", "row").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"), F.flatten(F.collect_list("lists")).alias("lists"))
    ids = F.transform(F.array_distinct(F.flatten("lists")), lambda i: i.cast("string"))
    return whole.select("id", "row", "spans", F.sort_array(ids).alias("item_ids"))


def _with_spans(docs: DataFrame, items: DataFrame, window: int, max_broadcast: int) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` and the spans of each, under names that no column has."""
    names = {c: fresh(docs, f"_{c}") for c in ("id", "row", "spans", "item_ids")}
    spans = contaminated_spans(docs, items, window, max_broadcast).withColumnsRenamed(names)
    own = fresh(docs, "_own")
    same = F.col("doc_id").eqNullSafe(F.col(names["id"])) & (F.col(own) == F.col(names["row"]))
    return docs.withColumn(own, row_key()).join(spans, same, "left"), names


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per document its words, those inside windows of items, the items, and whether there is any."""
    counted = docs.select("doc_id", row_key().alias("own"), F.size(words(F.col("text"), BETWEEN)).cast("long").alias("n_words"))
    spans = contaminated_spans(docs, items, window, max_broadcast)
    both = counted.join(spans, F.expr("doc_id <=> id and own = row"), "left")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return both.select(
        "doc_id", "n_words", F.coalesce(hit, F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), F.col("spans").isNotNull().alias("contaminated"))


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` without the words of the items' windows and what stands between and behind them."""
    both, names = _with_spans(docs, items, window, max_broadcast)
    spans = names["spans"]
    # every piece is a word and what follows it; what precedes the first word is kept
    lead, pieces = F.regexp_extract("text", f"^[{_BETWEEN_ANY}]*", 0), fresh(both, "_pieces")
    cut = F.regexp_extract_all("text", F.lit(f"[^{_BETWEEN_ANY}]+[{_BETWEEN_ANY}]*"), F.lit(0))
    both = both.withColumn(pieces, F.when(F.col(spans).isNotNull(), cut))
    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["to"]))
    ends = F.concat(F.transform(spans, lambda s: s["from"]), F.array(F.size(pieces)))
    gaps = F.zip_with(begins, ends, lambda lo, hi: F.array_join(F.slice(pieces, lo + 1, hi - lo), ""))
    kept = F.concat(lead, F.array_join(gaps, ""))
    return both.select(*[F.when(F.col(spans).isNull(), F.col("text")).otherwise(kept).alias(c) if c == "text" else F.col(c) for c in docs.columns])


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_share: float = 0.0, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` without those of whose words more than ``max_share`` stand in windows of items."""
    both, names = _with_spans(docs, items, window, max_broadcast)
    hit = F.aggregate(names["spans"], F.lit(0), lambda n, s: n + s["to"] - s["from"])
    share = hit / F.greatest(F.size(words(F.col("text"), BETWEEN)), F.lit(1))
    return both.filter(F.col(names["spans"]).isNull() | (share <= max_share)).select(*docs.columns)
