"""Line dedup by site-relative frequency.

A line (trimmed of spaces and tabs) is boilerplate of its host if it stands on at least MIN_PAGES of the host's pages and on
more than MAX_RATIO of them; a page counts once per line however often it repeats it. Such lines are taken out of the
host's pages and the other lines stay as they are. A page all of whose lines are boilerplate is a copy of other pages: it is
reported as such and left whole, as dropping all copies would lose the text that document dedup keeps once.

Lines are counted under a 128-bit key (two independent 64-bit hashes), first within tasks, so a line or a host with a third of all
rows shuffles a row per task. The boilerplate lines themselves are at most hosts / MAX_RATIO times the lines of a page; they are
gathered per host and joined to the pages by host, so page texts are never shuffled if that table is small enough to
broadcast by Spark's own size check, and are dealt by host with skew splitting otherwise.

A null host is a host of its own; null texts count as pages without lines and stay null; blank lines are never boilerplate.
Repeated rows count as pages each. Extra columns are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import fresh, materialize, read_table

MAX_RATIO = 0.02
MIN_PAGES = 5


def _key(line: str) -> str:
    return f"concat(hex(xxhash64({line})), hex(xxhash64(1, {line})))"


def _trim(line: str) -> str:
    return f"trim(both ' \t\r' from {line})"


def boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages (_host, _text) -> _host, _drop: the keys of the host's boilerplate lines."""
    keys = F.expr(f"array_distinct(transform(filter(split(_text, '\n', -1), x -> length({_trim('x')}) > 0), x -> {_key(_trim('x'))}))")
    lines = pages.select("_host", F.explode(keys).alias("key"))
    counts = lines.groupBy("_host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy("_host").agg(F.count("*").alias("pages"))
    often = counts.join(totals, counts["_host"].eqNullSafe(totals["_host"])).where(F.col("n") > F.lit(max_ratio) * F.col("pages")).select(counts["_host"], "key")
    return often.groupBy("_host").agg(F.array_sort(F.collect_list("key")).alias("_drop"))


def drop_boilerplate(docs: DataFrame, host: str | Column = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, lines_in: str = "_lines_in", lines_out: str = "_lines_out", copy: str = "_is_copy") -> DataFrame:
    """All columns of docs with the text cleaned, plus the non-blank lines before and after, and whether all lines were
    boilerplate and so the page was left whole (`lines_out` counts its lines all the same)."""
    names = docs.columns
    if set(names) & {lines_in, lines_out, copy}:
        raise ValueError("docs has a column of an output's name")
    host = F.col(host) if isinstance(host, str) else host
    often = materialize(boilerplate(docs.select(host.alias("_host"), F.col("text").alias("_text")), max_ratio, min_pages), "boilerplate")
    own, site, drop, lines, kept, before, after = fresh(docs, "_own_host", "_site", "_drop_keys", "_lines", "_kept", "_before", "_after")
    often = often.select(F.col("_host").alias(site), F.col("_drop").alias(drop))
    joined = docs.withColumn(own, host).join(often, F.col(own).eqNullSafe(F.col(site)), "left")
    filled = f"x -> length({_trim('x')}) > 0"
    joined = joined.withColumn(lines, F.expr("split(text, '\n', -1)"))
    joined = joined.withColumn(kept, F.expr(f"case when {drop} is null then {lines} else filter({lines}, x -> length({_trim('x')}) = 0 or not array_contains({drop}, {_key(_trim('x'))})) end"))
    joined = joined.withColumn(before, F.expr(f"size(filter({lines}, {filled}))")).withColumn(after, F.expr(f"size(filter({kept}, {filled}))"))
    whole = (F.col(after) == 0) & (F.col(before) > 0)
    text = F.when((F.col(before) == F.col(after)) | whole, F.col("text")).otherwise(F.array_join(kept, "\n"))
    fixed = [text.alias("text") if n == "text" else F.col(f"`{n}`") for n in names]
    count = lambda c: F.coalesce(F.greatest(c, F.lit(0)), F.lit(0)).cast("long")
    return joined.select(*fixed, count(F.col(before)).alias(lines_in), count(F.when(whole, F.col(before)).otherwise(F.col(after))).alias(lines_out), F.coalesce(whole, F.lit(False)).alias(copy))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("_lines_in").alias("lines_in"), F.col("_lines_out").alias("lines_kept"), F.col("_is_copy").alias("left_whole"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "text")


ORACLE = """
with docs as (select row_number() over () as r, * from documents),
lines as (select r, doc_id, source, t.line, t.pos, trim(t.line, ' ' || chr(9) || chr(13)) as bare
          from docs, unnest(string_split(text, chr(10))) with ordinality as t(line, pos)),
freq as (select source, bare, count(distinct r) as n from lines where bare <> '' group by 1, 2),
total as (select source, count(*) as pages from documents group by 1),
often as (select f.source, f.bare from freq f join total t on f.source is not distinct from t.source
          where n >= 5 and n > 0.02::double * pages),
marked as (select l.*, o.bare is not null as drop_it from lines l left join often o on l.source is not distinct from o.source and l.bare = o.bare),
agg as (select r, count(*) filter (bare <> '') as lines_in, count(*) filter (bare <> '' and not drop_it) as lines_out,
               string_agg(line, chr(10) order by pos) filter (not drop_it) as kept
        from marked group by 1)
select doc_id, coalesce(lines_in, 0) as lines_in,
       coalesce(case when lines_out = 0 then lines_in else lines_out end, 0) as lines_kept,
       coalesce(lines_out = 0 and lines_in > 0, false) as left_whole,
       case when lines_out = lines_in or lines_out = 0 then text else kept end as text,
       sha256(case when lines_out = lines_in or lines_out = 0 then text else kept end) as text_sha256
from docs left join agg using (r)
"""
