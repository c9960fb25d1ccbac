"""Quality rules with cross-document line frequency; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, Cut, join_counted


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def repeated_words(words: str, width: int = 5) -> Column:
    """Words inside windows of so many words that the text holds twice or more."""
    windows = F.expr(f"if(size({words}) >= {width}, transform(sequence(0, size({words}) - {width}), i -> xxhash64({', '.join(f'get({words}, i + {j})' for j in range(width))})), array())")
    return F.when(
        F.size(F.col("__w")) > F.size(F.array_distinct("__w")),
        F.expr(
            f"""aggregate(transform(array(array_sort(transform(__w, (x, i) -> struct(x, i)))), s ->
                    transform(array(sort_array(transform(filter(s, (x, i) -> coalesce(x.x = get(s, i - 1).x, false) or coalesce(x.x = get(s, i + 1).x, false)), x -> x.i))), p ->
                        aggregate(transform(p, (x, k) -> least({width}, coalesce(get(p, k + 1) - x, {width}))), 0L, (a, x) -> a + x))), 0L, (a, x) -> a + x[0])"""
        ),
    ).otherwise(F.lit(0).cast("long")), windows


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    Null text counts as empty: all zero, base_failed true. Very long texts are handled inside their row.
    """
    repeated, windows = repeated_words("__words")
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    out = docs.withColumn("__words", words_of(F.col(text))).withColumn("__lines", lines).withColumn("__w", windows)
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.aggregate("__words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
            "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": repeated,
        }
    )
    return out.drop("__words", "__lines", "__w").withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def lines_above(lines: DataFrame, hosts: DataFrame, most_docs: int, percent: int, least_docs: int) -> DataFrame:
    """(host, line) of the lines that more documents of a host hold than its limit: most_docs, or where that is less, a percentage of the host's documents, but least_docs at least.

    lines has (host, unit, line), hosts (host, unit), a unit being what counts as a document. Repeats within a unit are made distinct first, which a hot
    host or line spreads over all tasks, and only then counted in partial sums.
    """
    counts = lines.distinct().groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > least_docs)
    sizes = hosts.distinct().groupBy("host").agg(F.count("*").alias("size")).select(F.col("host").alias("own_host"), "size")
    return counts.join(sizes, F.col("host").eqNullSafe(F.col("own_host"))).where((F.col("docs") > most_docs) | (100 * F.col("docs") > percent * F.col("size"))).select("host", "line")


def normal_line(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(line), SPACES, " "), "[0-9]+", "0"), F.lit(" "))


def without_lines(text: str, hashes: str) -> Column:
    """The text without the lines whose normalised forms have one of the hashes; without such lines it stays as it is, byte by byte."""
    rest = F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains(F.col(hashes), F.xxhash64(normal_line(x))))
    return F.when(F.col(hashes).isNotNull(), F.array_join(rest, "\n")).otherwise(F.col(text))


def line_hashes(text: str) -> Column:
    """(line, words) of every line that has a word: the hash of its normalised form (lower case, digit runs as 0, one space between words), and its number of words."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    normal = F.transform(lines, normal_line)
    return F.transform(F.filter(normal, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).cast("long").alias("words")))


#: What the operator adds to a row.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")
KEY = ("__id", "__host", "__text")
#: Changed documents that are broadcast at most, after counting them; more are shuffled.
BROADCAST_CHANGES = 100_000


def keyed(docs: DataFrame, doc_id: str, host: str, text: str) -> DataFrame:
    """The rows with KEY: id, host and hash of the text."""
    return docs.withColumns({"__id": F.col(doc_id), "__host": F.col(host), "__text": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})


def verdicts(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", count: str = "documents", most_docs: int = 50, percent: int = 10, least_docs: int = 5, keep_share: float = 0.3, keep_words: int = 10) -> DataFrame:
    """A row for each row: KEY, RESULTS, and __over, the hashes of its lines above their host's limit (null without any).

    The texts are read once; numbers and the hashes of lines are written and read again. A line counts once for each of a host's "documents" (its ids; a row without one counts
    by its text) or of its "texts", where exact copies are one. A document that keeps fewer than keep_words words or a smaller part of them than keep_share is rejected. Null text
    is empty, a null host is a host of its own, repeated rows are judged alike, an empty table gives an empty one; a long text is handled inside its row.
    """
    cut = Cut(docs.sparkSession)
    rows = keyed(docs, doc_id, host, text).select(*KEY, F.col(text).alias("__body"), line_hashes(text).alias("__hashes"))
    rows = cut.table(base_rules(rows, "__body").drop("__body"))
    by_text = F.lit(count == "texts") | F.col("__id").isNull()
    unit = F.struct(F.when(~by_text, F.col("__id")).alias("id"), F.when(by_text, F.col("__text")).alias("text")).alias("unit")
    owner = F.col("__host").alias("host")
    above = lines_above(rows.select(owner, unit, F.explode("__hashes.line").alias("line")), rows.select(owner, unit), most_docs, percent, least_docs)
    above = cut.table(above.select(F.struct("host", "line").alias("__key")))
    lines = rows.select(*KEY, F.explode(F.array_distinct("__hashes.line")).alias("line")).withColumn("__key", F.struct(owner, "line"))
    over = join_counted(lines, above, "__key").groupBy(*KEY).agg(F.collect_set("line").alias("__over"))
    out = rows.join(over.select(*[F.col(c).alias(f"{c}_") for c in KEY], "__over"), same_key(), "left").drop(*[f"{c}_" for c in KEY])
    gone = F.aggregate(F.filter("__hashes", lambda x: F.array_contains("__over", x["line"])), F.lit(0).cast("long"), lambda a, x: a + x["words"])
    out = out.withColumn("n_removed_words", F.coalesce(gone, F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("n_removed_words")
    kept = F.when(F.col("base_failed"), False).otherwise((left >= keep_words) & (left >= F.lit(keep_share) * F.col("n_words")))
    return out.withColumn("kept", kept).select(*KEY, *RESULTS, "__over")


def same_key() -> Column:
    return F.col("__id").eqNullSafe(F.col("__id_")) & F.col("__host").eqNullSafe(F.col("__host_")) & (F.col("__text") == F.col("__text_"))


def once(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for each KEY, whose columns get names of their own."""
    return rows.dropDuplicates([*KEY]).select(*[F.col(c).alias(f"{c}_") for c in KEY], *columns)


def judge(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", **limits) -> DataFrame:
    """The rows with RESULTS and clean_text, the text without the lines above their host's limit; limits as in verdicts(), which also says what nulls, repeats and empty tables give.

    Other columns pass through, those of the results' names are replaced.
    """
    docs = docs.drop(*RESULTS, "clean_text")
    found = once(verdicts(docs, doc_id, host, text, **limits), *RESULTS, "__over")
    out = keyed(docs, doc_id, host, text).join(found, same_key(), "left").withColumn("clean_text", without_lines(text, "__over"))
    return out.select(*docs.columns, *RESULTS, "clean_text")


def clean(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", **limits) -> DataFrame:
    """The rows that verdicts() keeps, their texts without the lines above their host's limit; all other columns, whatever their names, are as they were.

    Only what is rejected or changed is joined with the texts, which are not shuffled while that is little.
    """
    found = verdicts(docs, doc_id, host, text, **limits).where("not kept or __over is not null")
    changed = Cut(docs.sparkSession).table(once(found, F.col("kept").alias("__kept"), "__over"))
    few = changed.limit(BROADCAST_CHANGES + 1).count() <= BROADCAST_CHANGES
    out = keyed(docs, doc_id, host, text).join(F.broadcast(changed) if few else changed, same_key(), "left").where(F.coalesce("__kept", F.lit(True)))
    return out.withColumn(text, without_lines(text, "__over")).select(*docs.columns)


QUALITY_SQL = r"""
with d as (select doc_id, source, coalesce(text, '') as text, coalesce('id ' || doc_id, 'text ' || md5(coalesce(text, ''))) as unit from documents),
w as (select doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select doc_id, unnest(range(0, len(ws) - 4)) as i, ws from w where len(ws) >= 5),
h as (select doc_id, i, count(*) over (partition by doc_id, ws[i+1], ws[i+2], ws[i+3], ws[i+4], ws[i+5]) as n from g),
r as (select doc_id, count(distinct j) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as j from h where n > 1) group by doc_id),
b as (select w.doc_id, source, text, cast(len(ws) as bigint) as n_words,
             cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
             cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
             cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
             cast(coalesce(r.n_repeat_words, 0) as bigint) as n_repeat_words
      from w left join r on r.doc_id = w.doc_id),
l as (select doc_id, source, unit, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ')), lambda x: x <> '')) as line from d),
f as (select source, line from l group by source, line
      having count(distinct unit) > 5 and (count(distinct unit) > 50 or 100 * count(distinct unit) > 10 * (select count(distinct unit) from d where d.source is not distinct from l.source))),
x as (select l.doc_id, sum(len(string_split(l.line, ' '))) as gone from l join f on f.line = l.line and f.source is not distinct from l.source group by l.doc_id),
k as (select b.*, n_words - coalesce(gone, 0) as left_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from b left join x on x.doc_id = b.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and left_words >= 10 and left_words >= 0.3 * n_words as kept
from k
"""
