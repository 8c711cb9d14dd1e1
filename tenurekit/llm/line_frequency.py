"""Quality rules by cross-document line frequency, in DataFrame functions only.

Lines are normalised (case, digits, white space) and hashed. For each host, the distinct documents with a line are
counted; exact copies of a text count once there, so copies of a good document do not condemn it. Lines above the limit
are boilerplate: they go, and a document that they leave depleted is rejected. The limit is a number of documents, the same
for a host of any size: a line in a thousandth of a large host's documents is as common as one in a tenth of a small one's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenurekit.llm.scratch import staged

#: A line is boilerplate from this number of its host's distinct texts on.
MAX_DOCS = 20
#: A document that keeps less than this share of its words, or fewer words than this, is depleted.
MIN_LEFT, MIN_WORDS = 0.5, 50
_BLANK = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _BLANK), lambda w: w != "")


def _spaced(text: Column) -> Column:
    """Lines in lower case, with runs of white space as one blank, trimmed."""
    return F.transform(F.split(text, "\n"), lambda line: F.trim(F.regexp_replace(F.lower(line), _BLANK, " ")))


def _key(spaced: Column) -> Column:
    """The hash by which spaced lines are compared: runs of digits count as 0 where under half of the characters are digits, so
    that page numbers and dates do not tell lines apart but rows of numbers stay what they are."""
    digits = F.length(spaced) - F.length(F.regexp_replace(spaced, "[0-9]", ""))
    few = 2 * digits < F.length(F.replace(spaced, F.lit(" "), F.lit("")))
    return F.xxhash64(F.when(~spaced.rlike("[0-9]"), spaced).when(few, F.regexp_replace(spaced, "[0-9]+", "0")).otherwise(spaced))


def _line_hashes(text: Column) -> Column:
    """A struct (h, n_words) for each line with a word."""
    lines = F.filter(_spaced(text), lambda line: line != "")
    return F.transform(lines, lambda line: F.struct(_key(line).alias("h"), F.size(F.split(line, " ")).alias("n_words")))


def text_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to rows with ``text`` (null: no words).

    n_repeat_words: trigrams are hashed with their place and sorted, so equal ones are neighbours; the places of those
    that occur twice are sorted again, and each adds the words (up to three) that the one before did not cover.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.regexp_replace(line, _BLANK, "")) > 0)
    out = docs.withColumns({"_w": words_of(text), "_lines": lines, "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("bigint")})
    w, s = F.col("_w"), F.col("_s")
    places = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    trigram = F.transform(places, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
    out = out.withColumns({
        "n_words": F.size("_w").cast("bigint"),
        "word_chars": F.length(F.array_join("_w", "")).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "_s": F.sort_array(trigram),
    }).drop("_w", "_lines")
    twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1).h == x.h, F.lit(False)) | F.coalesce(F.get(s, i - 1).h == x.h, F.lit(False)))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc.n + F.least(F.lit(3), p - acc.last)).alias("n"))
    repeated = F.aggregate(F.sort_array(F.transform(twice, lambda x: x.p)), start, step, lambda acc: acc.n)
    return out.withColumn("n_repeat_words", repeated).drop("_s")


def _host(docs: DataFrame, host: str) -> Column:
    return F.coalesce(docs[host].cast("string"), F.lit("\x00"))


def lines_of(docs: DataFrame, host: str = "source") -> DataFrame:
    """(host, t, place, h, n_words): each line with a word of each distinct text t (a hash) of a host. Null hosts are one host."""
    own = docs.select(_host(docs, host).alias("host"), F.xxhash64("text").alias("t"), F.posexplode(_line_hashes(F.coalesce("text", F.lit("")))).alias("place", "line"))
    return own.select("host", "t", "place", "line.h", "line.n_words").distinct()


def frequent_lines(lines: DataFrame) -> DataFrame:
    """(host, h): hashes of boilerplate lines."""
    counts = lines.select("host", "h", "t").distinct().groupBy("host", "h").agg(F.count("*").alias("n_docs"))
    return counts.where(F.col("n_docs") >= MAX_DOCS).select("host", "h")


def judged(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, the counts of ``text_counts``, n_left (words outside boilerplate lines), base_failed, kept.

    base_failed: under 50 words, or more than half of the words in repeated trigrams. kept: not failed, and outside
    boilerplate at least half of the words are left and 50 of them. Null and empty texts have no words and fail. Repeated rows are judged alike.
    Extra columns do not matter.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("source"))
    gone = _gone(docs).drop("gone")
    counted = text_counts(docs.select("doc_id", _host(docs, "source").alias("host"), F.xxhash64("text").alias("t"), "text")).drop("text")
    out = counted.join(gone, ["host", "t"], "left").withColumn("n_left", F.col("n_words") - F.coalesce("n_gone", F.lit(0)))
    kept = ~_failed() & ~_depleted(F.col("n_left"), F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_left", _failed().alias("base_failed"), kept.alias("kept"))


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _depleted(left: Column, words: Column) -> Column:
    return (left < MIN_LEFT * words) | (left < MIN_WORDS)


def _gone(docs: DataFrame) -> DataFrame:
    """(host, t, n_gone, n_all, gone): words in boilerplate lines, all words, and the lines' hashes, of texts with such lines.

    Written, as are the tables it comes from: so joins find both inputs exchanged for them and AQE can split a hot line
    or a hot text.
    """
    lines = staged(lines_of(docs), "lines")
    frequent = staged(frequent_lines(lines), "lines-frequent")
    marked = lines.join(frequent.withColumn("boilerplate", F.lit(True)), ["host", "h"], "left")
    sums = marked.groupBy("host", "t").agg(
        F.sum(F.when(F.col("boilerplate"), F.col("n_words"))).alias("n_gone"), F.sum("n_words").alias("n_all"),
        F.collect_set(F.when(F.col("boilerplate"), F.col("h"))).alias("gone"),
    )
    return staged(sums.where("n_gone > 0"), "lines-gone")


def kept_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs that ``judged`` keeps, with all their columns.

    Texts are told apart by host and 64-bit hash.
    """
    return _kept(docs, host).select("row.*")


def cleaned_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows that ``judged`` keeps, without their boilerplate lines; ``n_chars``, if there is one, is that of the text left."""
    changed = F.col("gone").isNotNull()
    row, left = F.col("row"), _without(F.col("text"), F.col("gone"))
    row = row.withField("text", F.when(changed, left).otherwise(row["text"]))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(changed, F.length(left).cast(kind)).otherwise(F.col("row.n_chars")))
    return _kept(docs, host).select(row.alias("row")).select("row.*")


def _kept(docs: DataFrame, host: str) -> DataFrame:
    """(row, text, gone) of the rows that stay."""
    gone = _gone(docs.select(F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("source")))
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"), _host(docs, host).alias("host"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    # a filter on the counts alone would be pushed below them, and then count anew for every use of a word; it isn't past a row number
    counted = text_counts(packed).withColumn("at", F.monotonically_increasing_id())
    met = counted.where(~_failed() & (F.col("at") >= 0)).join(gone, ["host", "t"], "left")
    return met.where(~F.coalesce(_depleted(F.col("n_all") - F.col("n_gone"), F.col("n_all")), F.lit(False))).select("row", "text", "gone")


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines whose hashes are given."""
    left = F.zip_with(F.split(text, "\n"), _spaced(text), lambda line, spaced: F.when(~F.array_contains(gone, _key(spaced)), line))
    return F.array_join(left, "\n")


def without_frequent_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """docs with boilerplate lines taken out of ``text``; all rows and columns stay, nulls stay null."""
    gone = _gone(docs.select(F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("source")))
    gone = gone.select(F.col("host").alias("_host"), F.col("t").alias("_t"), F.col("gone").alias("_gone"))
    keyed = docs.withColumns({"_own_host": _host(docs, host), "_own_t": F.xxhash64(F.col("text").cast("string"))})
    met = keyed.join(gone, (F.col("_own_host") == F.col("_host")) & (F.col("_own_t") == F.col("_t")), "left")
    left = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("_gone")))
    return met.withColumn("text", left).select(*docs.columns)
