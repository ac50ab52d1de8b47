"""Benchmark decontamination with DataFrame functions only: windows of benchmark words form a hash set that goes
to every task, training windows are looked up in it, hits are verified word by word, and spans or documents go. Only
rows with hits are shuffled, and never their texts.

Defined cases: null text has no words; an item without words has no window; a document with a null id or a
repeated id is a row of its own; other columns of either table, whatever their names, are ignored by
``contamination`` and kept by ``decontaminate``; an empty benchmark leaves every document clean. docs must read the same
rows each time (a table).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, with_row_id, written

#: What separates words, after A-Z have become a-z.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z only; ``lower`` is the same where the text is ASCII, and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS, -1), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, width: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, length, gram): the distinct windows of each item."""
    words = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
    words = words.where(F.size("words") > 0).withColumn("length", F.least(F.lit(width), F.size("words")))
    return words.select("item", "length", F.explode(F.expr(
        "transform(sequence(1, size(words) - length + 1), i -> array_join(slice(words, i, length), ' '))")).alias("gram")).distinct()


def _start(words: str, i: str, n: str) -> str:
    """Hash of a window's length and its first words, two at most."""
    return f"xxhash64({n}, {words}[{i} - 1], if({n} > 1, {words}[{i}], ''))"


def _windows_hit(rows: DataFrame, windows: DataFrame, lengths: list[int], first: bool) -> DataFrame:
    """(_row, doc_id, n_words, pos, length, gram) of the places whose hashes are in the sets of these windows; on the first pass
    a row of place 0 for each document too. Places are made, hashed and looked up one after the other within one stage."""
    n = len(lengths)
    some = rows.select("_row", "doc_id", "words", F.explode_outer(F.expr(f"sequence({-1 if first else 0}, size(words) * {n}, 1)")).alias("_j"))
    pos, length = (f"int(_j div {n}) + 1", f"array({', '.join(map(str, lengths))})[_j % {n}]") if n else ("0", "0")
    some = some.withColumn("pos", F.expr(f"if(_j < 0, 0, {pos})")).withColumn("length", F.expr(f"if(_j < 0, 0, {length})"))
    some = some.where("pos = 0 or (length > 0 and pos + length - 1 <= size(words))")
    head = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("h")) if first else None
    starts = windows.select("start").distinct()
    hashes = windows.select("h").distinct()
    if first:
        starts, hashes = starts.union(head.select("start")), hashes.union(head.select("h"))
    some = some.withColumn("start", F.expr(f"if(pos = 0, 0L, {_start('words', 'pos', 'length')})")).join(F.broadcast(starts), "start", "left_semi")
    some = some.withColumn("h", F.expr("if(pos = 0, 0L, xxhash64(length, slice(words, pos, length)))")).join(F.broadcast(hashes), "h", "left_semi")
    return some.select("_row", "doc_id", F.when(F.col("pos") == 0, F.size("words").cast("long")).alias("n_words"), "pos", "length",
                       F.expr("if(pos = 0, null, array_join(slice(words, pos, length), ' '))").alias("gram"))


def _places(docs: DataFrame, members: DataFrame, set_rows: int, doc: str, text: str, row: str | None) -> DataFrame:
    """What ``_windows_hit`` finds of all windows, written: the sets go to the tasks in passes of ``set_rows`` windows."""
    windows = members.select("length", "gram").distinct().withColumn("h", F.expr("xxhash64(length, split(gram, ' '))"))
    windows = written(windows.withColumn("start", F.expr(_start("split(gram, ' ')", "1", "length"))), "windows")
    about = windows.agg(F.array_sort(F.collect_set("length")).alias("lengths"), F.count("*").alias("n")).first()  # width lengths at most
    rows = docs.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").alias("_text"), *([F.col(f"`{row}`").alias("_row")] if row else []))
    rows = (rows if row else with_row_id(rows)).select("_row", "doc_id", words_of(F.col("_text")).alias("words"))
    passes = max(1, -(-about.n // set_rows))
    found = None
    for k in range(passes):
        one = _windows_hit(rows, windows.where(F.pmod("h", F.lit(passes)) == k), about.lengths, k == 0)
        found = one if found is None else found.unionByName(one)
    return written(found, "places")


def _item_lists(hits: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_row, lists) and (lists, items). The items of a window are a numbered list, windows with the same items share one, and
    documents with the same lists share a set of them: items are spelt out once for each such set, not for each hit."""
    per_window = members.groupBy("gram", "length").agg(F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("item")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("b")).alias("list"))
    numbered = written(members.join(per_window, ["gram", "length"]), "item-lists")
    of_row = hits.select("_row", "gram", "length").distinct().join(numbered.select("gram", "length", "list").distinct(), ["gram", "length"]).select("_row", "list").distinct()
    sets = of_row.groupBy("_row").agg(F.array_sort(F.collect_set("list")).alias("set")).withColumn("lists", F.md5(F.to_json("set").cast("binary")))
    sets = written(sets, "item-sets")
    spelt = sets.groupBy("lists").agg(F.any_value("set").alias("set")).select("lists", F.explode("set").alias("list"))
    items = spelt.join(numbered.select("list", "item").distinct(), "list").select("lists", "item").distinct()
    return sets.select("_row", "lists"), items.groupBy("lists").agg(F.array_sort(F.collect_list("item")).alias("items"))


def _contamination(docs: DataFrame, benchmark: DataFrame, width: int, set_rows: int, doc: str, text: str, row: str | None, items: bool) -> tuple[DataFrame, DataFrame | None]:
    members = written(benchmark_windows(benchmark, width), "members")
    found = _places(docs, members, set_rows, doc, text, row)
    # the words of hits are compared one by one
    hits = found.where("pos > 0").join(members.select("gram", "length").distinct(), ["gram", "length"])
    runs = hits.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct((F.col("pos") - 1).alias("first"), (F.col("pos") - 1 + F.col("length")).alias("end")))).alias("raw"))
    merged = F.expr("""aggregate(raw, cast(array() as array<struct<first:int,end:int>>), (acc, x) ->
        if(size(acc) > 0 and element_at(acc, -1).end >= x.first,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'end', greatest(element_at(acc, -1).end, x.end)))),
           concat(acc, array(x))))""")
    runs = runs.select("_row", merged.alias("spans"))
    lists = None
    if items:
        of_row, lists = _item_lists(hits, members)
        runs = runs.join(of_row, "_row", "left")
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<first:int,end:int>>)")).alias("spans")
    rows = found.where("pos = 0").select("_row", "doc_id", "n_words").join(runs, "_row", "left")
    return rows.select("_row", "doc_id", "n_words", spans, *(["lists"] if items else [])).withColumn(
        "n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.first)")), lists


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, set_rows: int = 1 << 21,
                  doc: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, spans (maximal hit runs as [first, end) word numbers), n_hit, items.

    Two hash sets of the benchmark's windows, of their first two words and of all their words, are broadcast; the first spares
    nearly all places the second. A set has at most ``set_rows`` windows (about 100 MB); a larger benchmark takes more passes over the
    documents, each with its share of the windows. Only hits are shuffled, and their words alone are compared one by one.
    ``row`` names a column of distinct row numbers, which is then kept as ``_row``."""
    found, lists = _contamination(docs, benchmark, width, set_rows, doc, text, row, True)
    items = F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")
    return found.join(lists, "lists", "left").select(*(["_row"] if row else []), "doc_id", "n_words", items, "spans", "n_hit")


def report(docs: DataFrame, benchmark: DataFrame, width: int = 10, set_rows: int = 1 << 21, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The digest columns of ``contamination``; items are digested once for each distinct set of them."""
    found, lists = _contamination(docs, benchmark, width, set_rows, doc, text, None, True)
    digests = lists.select("lists", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return found.join(digests, "lists", "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, mode: str = "documents",
                  doc: str = "doc_id", text: str = "text", set_rows: int = 1 << 21) -> DataFrame:
    """docs without contaminated documents (``mode='documents'``), or with the hit words and what stands between
    them cut out of their texts (``mode='spans'``). Columns stay as they were."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode {mode!r}")
    rows = with_row_id(docs, name := unused(docs.columns, "_row"))
    found = _contamination(rows, benchmark, width, set_rows, doc, text, name, False)[0].where("n_hit > 0")
    if mode == "documents":
        gone = found.select(F.col("_row").alias(name))
        return rows.join(gone, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    # pieces are words and separators by turns; word j is piece 2 j, or 2 j + 1 if the text starts with a separator
    spans = found.select(F.col("_row").alias(name), "spans")
    both = rows.select(name, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")).join(spans, name, "left")
    pieces = both.withColumn("pieces", F.expr(
        rf"regexp_extract_all(whole.`{text}`, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+|[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 0)"))
    pieces = pieces.withColumn("first", F.expr(rf"cast(whole.`{text}` rlike '^[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]' as int)"))
    cut = F.expr("array_join(filter(pieces, (p, i) -> not exists(spans, s -> i >= 2 * s.first + first and i < 2 * s.end - 1 + first)), '')")
    kept = F.when(F.col("spans").isNotNull(), cut).otherwise(F.col(f"whole.`{text}`"))
    return pieces.withColumn("cut", kept).select(*[F.col("cut").alias(c) if c == text else F.col(f"whole.`{c}`").alias(c) for c in docs.columns])
