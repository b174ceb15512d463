"""A query for each operator over the driver's tables, and the same in SQL.

The file tree is made from `documents`: source/lang/doc_<id>.txt with the text as content.  The state of an earlier
run drops every document with doc_id % 10 = 2, has another hash where it is 1, and the present lacks those where it
is 0: so all three kinds of change occur.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborfold.config import Config, Step
from arborfold.functions import paths, text
from arborfold.operators import facts, prefix, reduce, tree
from arborfold.plans import state as kept
from arborfold.plans.backends import Digest, Echo
from arborfold.plans.pipeline import MARKER, call_plan, facts_of, global_prompts, reduce_tree
from arborfold.plans.scratch import folder
from arborfold.sources.files import TableFiles
from arborfold.sources.listing import in_order, listing
from arborfold.sources.tables import document_files
from arborfold.sources.text_tree import write_tree

NUM_CTX = 512
LIMIT = text.file_budget(NUM_CTX)
OVERLAP = text.overlap_of(LIMIT)
BUDGET = text.reduce_budget(NUM_CTX)
CONFIG = replace(Config(), num_ctx=NUM_CTX, system_prompt="S", module_synthesis_prompt="M", architecture_prompt="A", file_fact_consolidation_prompt="C", extraction_steps=(Step("ONE", "p1"), Step("TWO", "p2")))
RULES = ["*_7.txt", "src3/", "src1*/de", "!src11/de", "doc_1?.txt"]
QUERIES: dict = {}
SQL: dict[str, str] = {}

FILES = "f AS (SELECT source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, doc_id, COALESCE(text, '') AS content, sha256(COALESCE(text, '')) AS sha256, source || '/' || lang AS dir FROM documents)"
CUR = f"{FILES}, cur AS (SELECT * FROM f WHERE doc_id % 10 <> 0), old AS (SELECT path, dir, CASE WHEN doc_id % 10 = 1 THEN sha256(content || '?') ELSE sha256 END AS sha256 FROM f WHERE doc_id % 10 <> 2)"
DIFF = f"{CUR}, diff AS (SELECT COALESCE(c.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'Added' WHEN c.path IS NULL THEN 'Deleted' ELSE 'Modified' END AS status FROM cur c FULL JOIN old o ON c.path = o.path WHERE c.sha256 IS DISTINCT FROM o.sha256)"
DIRS = "dirs AS (SELECT DISTINCT unnest(['.', split_part(path, '/', 1), dir]) AS path FROM {})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _doc_id() -> Column:
    return F.regexp_extract("path", r"doc_(\d+)\.txt$", 1).cast("long")


def _present(spark, sf) -> DataFrame:
    return document_files(spark, sf).filter(_doc_id() % 10 != 0)


def _known(spark, sf) -> DataFrame:
    f = document_files(spark, sf).filter(_doc_id() % 10 != 2)
    return f.select("path", F.when(_doc_id() % 10 == 1, F.sha2(F.concat("content", F.lit("?")), 256)).otherwise(F.col("sha256")).alias("sha256"), F.concat(F.lit("facts of "), "path").alias("facts"))


def _odd_paths(spark, sf) -> DataFrame:
    """The tree with hidden parts."""
    p = F.when(_doc_id() % 13 == 0, F.concat(F.lit(".hid/"), "path")).when(_doc_id() % 13 == 1, F.replace("path", F.lit("/doc"), F.lit("/.doc"))).when(_doc_id() % 13 == 2, F.replace("path", F.lit("/doc"), F.lit("/x.egg-info/doc"))).otherwise(F.col("path"))
    return document_files(spark, sf).select(p.alias("path"), "sha256", "content", "error")


ODD = f"{FILES}, odd AS (SELECT CASE doc_id % 13 WHEN 0 THEN '.hid/' || path WHEN 1 THEN replace(path, '/doc', '/.doc') WHEN 2 THEN replace(path, '/doc', '/x.egg-info/doc') ELSE path END AS path, doc_id FROM f)"
IGNORED = r"""CASE WHEN regexp_matches(path, '(^|/)\.|\.egg-info(/|$)') THEN TRUE WHEN regexp_matches(path, '(^|/)doc_1[^/]\.txt(/|$)') THEN TRUE WHEN regexp_matches(path, '^src11/de(/|$)') THEN FALSE
  WHEN regexp_matches(path, '^src1[^/]*/de(/|$)') THEN TRUE WHEN regexp_matches(path, '(^|/)src3/') THEN TRUE WHEN regexp_matches(path, '(^|/)[^/]*_7\.txt(/|$)') THEN TRUE ELSE FALSE END"""


@query(f"WITH {FILES} SELECT path, dir, 'doc_' || doc_id || '.txt' AS name, CAST(length(content) AS BIGINT) AS n_chars FROM f")
def scan_files(spark: SparkSession, sf: str) -> DataFrame:
    return document_files(spark, sf).select("path", paths.directory(F.col("path")).alias("dir"), paths.base_name(F.col("path")).alias("name"), F.char_length("content").cast("long").alias("n_chars"))


@query(rf"""WITH {ODD}, r AS (SELECT path FROM odd WHERE NOT ({IGNORED}) AND NOT regexp_matches(path, '^src3/|^src1[^/]*/de/') OR regexp_matches(path, '^src11/de/') AND NOT ({IGNORED}))
SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS ord FROM r""")
def discover_files(spark, sf):
    """A real tree, written by the sink and listed by the source, in the order of a walk."""
    root = f"{folder(spark).removeprefix('file://').removeprefix('file:')}/tree-{uuid.uuid4().hex}"
    write_tree(_odd_paths(spark, sf).select("path", F.lit("").alias("content")), root)
    return in_order(listing(spark, root, RULES).select("path"))


@query(f"WITH {FILES} SELECT path, sha256 FROM f")
def file_sha256(spark, sf):
    return document_files(spark, sf).select("path", "sha256")


@query(rf"WITH {ODD} SELECT path, regexp_matches(path, '(^|/)\.|\.egg-info(/|$)') AS hidden FROM odd")
def filter_hidden(spark, sf):
    return _odd_paths(spark, sf).select("path", paths.hidden(F.col("path")).alias("hidden"))


@query(rf"WITH {FILES} SELECT path, regexp_matches(path, '(^|/)[^/]*_7\.txt(/|$)') OR regexp_matches(path, '(^|/)src3/') AS ignored FROM f")
def ignore_match(spark, sf):
    return document_files(spark, sf).select("path", paths.ignored(F.col("path"), RULES[:2]).alias("ignored"))


@query(f"WITH {FILES} SELECT path, {IGNORED} AS ignored FROM f")
def ignore_negation(spark, sf):
    return document_files(spark, sf).select("path", paths.ignored(F.col("path"), RULES).alias("ignored"))


@query(rf"WITH {FILES}, {DIRS.format('f')}, shut AS (SELECT path FROM dirs WHERE path <> '.' AND (regexp_matches(path, '^src1[^/]*(/|$)') OR regexp_matches(path, '(^|/)fr(/|$)'))) SELECT path FROM f WHERE dir NOT IN (SELECT path FROM shut) AND split_part(path, '/', 1) NOT IN (SELECT path FROM shut)")
def prune_subtree(spark, sf):
    """`!src11/de/*` can't bring back what lies below the ignored src11; `fr/` shuts directories of that name anywhere."""
    return tree.unignored(document_files(spark, sf), ["src1*", "fr/", "!src11/de/*"]).select("path")


@query(r"SELECT doc_id, trim(l, E' \t\r') AS line FROM (SELECT doc_id, unnest(string_split(COALESCE(text, ''), chr(10))) AS l FROM documents) WHERE trim(l, E' \t\r') <> '' AND NOT starts_with(trim(l, E' \t\r'), '#')")
def gitignore_lines(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    lines = d.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("l"))
    return lines.select("doc_id", text.trimmed(F.col("l")).alias("line")).filter("line <> '' and not startswith(line, '#')")


@query("WITH w AS (SELECT doc_id, string_split(COALESCE(text, ''), ' ') AS ws FROM documents) SELECT doc_id, array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i), ' ') AS words FROM w")
def dedupe_ordered(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", F.array_join(F.array_distinct(F.split(F.coalesce("text", F.lit("")), " ")), " ").alias("words"))


@query(r"""WITH t AS (SELECT doc_id, trim(CASE doc_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' Clear' ELSE COALESCE(text, '') END, E' \t\n\r') AS t FROM documents)
SELECT doc_id, t <> '' AS modified, CASE WHEN t = '' OR lower(t) IN ('clear', 'none') THEN '' ELSE array_to_string(list_filter(list_transform(string_split(t, ','), lambda x: trim(x, E' \t\n\r')), lambda x: x <> ''), '|') END AS items FROM t""")
def csv_list_parse(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    t = F.when(F.col("doc_id") % 5 == 0, "  ").when(F.col("doc_id") % 5 == 1, " Clear").otherwise(F.coalesce("text", F.lit("")))
    items = text.list_of(t)
    return d.select("doc_id", items.isNotNull().alias("modified"), F.coalesce(F.array_join(items, "|"), F.lit("")).alias("items"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'flag' WHEN c_custkey % 3 = 0 THEN 'env' WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'default' END AS value FROM customer")
def config_precedence(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    tier = lambda n, v: F.when(F.col("c_custkey") % n == 0, v).otherwise("")
    return c.select("c_custkey", text.or_default(tier(5, F.lit("flag")), text.or_default(tier(3, F.lit("env")), text.or_default(tier(2, F.col("c_mktsegment")), "default"))).alias("value"))


@query("WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '../' || page_id WHEN 1 THEN 'a/../../' || page_id WHEN 2 THEN '..config/' || page_id WHEN 3 THEN 'a/./b/../' || page_id ELSE '/../' || page_id END AS path FROM pages) SELECT page_id, path, page_id % 5 IN (0, 1, 4) AS escapes FROM p")
def path_guard_lexical(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    m, i = F.col("page_id") % 5, F.col("page_id").cast("string")
    path = F.when(m == 0, F.concat(F.lit("../"), i)).when(m == 1, F.concat(F.lit("a/../../"), i)).when(m == 2, F.concat(F.lit("..config/"), i)).when(m == 3, F.concat(F.lit("a/./b/../"), i)).otherwise(F.concat(F.lit("/../"), i))
    return p.select("page_id", path.alias("path")).withColumn("escapes", paths.escapes(F.col("path")))


@query(f"WITH {FILES}, {DIRS.format('f')} SELECT path, CASE WHEN path = '.' THEN NULL WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS parent, CASE WHEN contains(path, '/') THEN split_part(path, '/', 2) ELSE path END AS name, CAST(CASE WHEN path = '.' THEN 0 WHEN contains(path, '/') THEN 2 ELSE 1 END AS INTEGER) AS depth FROM dirs")
def dir_tree(spark, sf):
    return tree.directories(document_files(spark, sf))


@query(f"WITH {FILES} SELECT dir AS path, COUNT(*) AS n_files FROM f GROUP BY dir")
def dir_files(spark, sf):
    return tree.file_counts(document_files(spark, sf))


@query(f"WITH {FILES}, {DIRS.format('f')}, d AS (SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS parent, CASE WHEN contains(path, '/') THEN split_part(path, '/', 2) ELSE path END AS name FROM dirs WHERE path <> '.') SELECT parent AS path, COUNT(*) AS n_children, MIN(name) AS first_child, MAX(name) AS last_child FROM d GROUP BY parent")
def dir_children(spark, sf):
    return tree.child_counts(tree.directories(document_files(spark, sf)))


@query(f"WITH {DIFF} SELECT path, status FROM diff")
def snapshot_diff(spark, sf):
    return tree.changes(_present(spark, sf), _known(spark, sf))


def _update(spark, sf):
    """An update of the present files, given the facts of the older ones and summaries of its directories and others."""
    own = tree.directories(document_files(spark, sf)).select("path")
    modules = own.union(own.filter("path <> '.'").select(F.concat("path", F.lit("_gone")))).select("path", F.lit("s").alias("summary"))
    state = kept.State(_known(spark, sf), modules, text.steps_hash(CONFIG.steps))
    return reduce_tree(_present(spark, sf), state, CONFIG, Digest())


@query(f"WITH {CUR} SELECT path, sha256 FROM old ANTI JOIN cur USING (path)")
def prune_files_state(spark, sf):
    """The files whose facts an update drops."""
    return _known(spark, sf).select("path", "sha256").join(_update(spark, sf).delta.gone["files"], "path", "left_semi")


@query(f"WITH {CUR}, {DIRS.format('f')}, live AS (SELECT DISTINCT unnest(['.', split_part(path, '/', 1), dir]) AS path FROM cur), m AS (SELECT path FROM dirs UNION SELECT path || '_gone' FROM dirs WHERE path <> '.') SELECT path FROM m ANTI JOIN live USING (path)")
def prune_modules_state(spark, sf):
    """The directories whose summaries an update drops."""
    return _update(spark, sf).delta.gone["modules"]


def _all(dirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return dirs.select("path"), dirs.select("path", F.lit("s").alias("summary"))


@query(f"WITH {DIFF} SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS path FROM diff")
def affected_direct(spark, sf):
    dirs = tree.directories(_present(spark, sf))
    return tree.directly_affected(dirs, tree.changes(_present(spark, sf), _known(spark, sf)), *_all(dirs))


@query(f"WITH {FILES}, {DIRS.format('f')} SELECT path FROM dirs WHERE ends_with(path, 'de')")
def affected_missing_page(spark, sf):
    f = document_files(spark, sf)
    dirs = tree.directories(f)
    pages, summaries = _all(dirs)
    return tree.directly_affected(dirs, tree.changes(f, f), pages.filter("not endswith(path, 'de')"), summaries)


@query(f"WITH {FILES}, {DIRS.format('f')} SELECT path FROM dirs WHERE ends_with(path, 'fr') OR ends_with(path, 'es')")
def affected_missing_summary(spark, sf):
    f = document_files(spark, sf)
    dirs = tree.directories(f)
    pages, _ = _all(dirs)
    summaries = dirs.filter("not endswith(path, 'fr')").select("path", F.when(F.col("path").endswith("es"), "").otherwise("s").alias("summary"))
    return tree.directly_affected(dirs, tree.changes(f, f), pages, summaries)


@query(f"WITH {DIFF}, x AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS path FROM diff), t AS (SELECT DISTINCT unnest(['.', split_part(path, '/', 1), dir]) AS path FROM cur) SELECT path FROM x UNION SELECT path FROM (SELECT unnest(['.', split_part(path, '/', 1)]) AS path FROM x) SEMI JOIN t USING (path)")
def affected_propagated(spark, sf):
    f, known = _present(spark, sf), _known(spark, sf)
    dirs, diff = tree.directories(f), tree.changes(f, known)
    direct = tree.directly_affected(dirs, diff, *_all(dirs))
    return tree.affected(dirs, direct, diff.filter("status = 'Deleted'").select("path"))


_ESCAPE = "replace(replace(replace({}, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')"


@query(f"SELECT p_partkey, sha256({_ESCAPE.format(chr(39) + '[{' + chr(34) + 'Name' + chr(34) + ':' + chr(34) + chr(39) + ' || p_brand || ' + chr(39) + chr(34) + ',' + chr(34) + 'Prompt' + chr(34) + ':' + chr(34) + chr(39) + ' || p_type || ' + chr(39) + '<&>' + chr(34) + '}]' + chr(39))}) AS steps_hash FROM part")
def steps_hash(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    steps = F.array(F.struct(F.col("p_brand").alias("Name"), F.concat("p_type", F.lit("<&>")).alias("Prompt")))
    return p.select("p_partkey", text.steps_hash_column(steps).alias("steps_hash"))


@query("SELECT p_partkey, CAST(n AS INTEGER) AS num_ctx, CAST(greatest(n, 512) * 3 AS INTEGER) AS file_limit, CAST(least(800, greatest(n, 512) * 3 // 4) AS INTEGER) AS overlap, CAST(n * 3 AS INTEGER) AS reduce_limit FROM (SELECT p_partkey, CAST(p_size AS INTEGER) * 50 AS n FROM part)")
def chunk_budget(spark, sf):
    """Budgets for a context size from each part's size: some under the least context, some over the largest overlap."""
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_size").cast("int") * 50).alias("num_ctx"))
    return p.select("p_partkey", "num_ctx", *(c.alias(n) for c, n in zip(text.budgets(F.col("num_ctx")), ("file_limit", "overlap", "reduce_limit"), strict=True)))


_COUNT = f"CASE WHEN length(content) <= {LIMIT} THEN 1 ELSE CAST(ceil((length(content) - {LIMIT}) / {float(LIMIT - OVERLAP)}) AS INTEGER) + 1 END"
CHUNKS = f"k AS (SELECT *, CAST({_COUNT} AS INTEGER) AS n_chunks FROM f), c AS (SELECT path, dir, doc_id, n_chunks, idx, substring(content, idx * {LIMIT - OVERLAP} + 1, {LIMIT}) AS chunk FROM (SELECT *, CAST(unnest(range(n_chunks)) AS INTEGER) AS idx FROM k))"


@query(f"WITH {FILES}, {CHUNKS} SELECT path, n_chunks FROM k")
def chunk_counts(spark, sf):
    return document_files(spark, sf).select("path", text.n_chunks(F.col("content"), LIMIT, OVERLAP).alias("n_chunks"))


@query(f"WITH {FILES}, {CHUNKS} SELECT path, idx, n_chunks, chunk AS text FROM c")
def chunk_overlap(spark, sf):
    f = document_files(spark, sf).select("path", text.chunks(F.col("content"), LIMIT, OVERLAP).alias("c"))
    return f.select("path", F.size("c").alias("n_chunks"), F.posexplode("c").alias("idx", "text"))


_PART, _LAP = BUDGET // 2, BUDGET // 10
_PARTS = f"CASE WHEN length(t) <= {BUDGET} THEN 1 ELSE CAST(ceil((length(t) - {_PART}) / {float(_PART - _LAP)}) AS INTEGER) + 1 END"


def _expanded(source: str) -> str:
    return f"(SELECT grp, ord, sub, CASE WHEN length(t) <= {BUDGET} THEN t ELSE substring(t, sub * {_PART - _LAP} + 1, {_PART}) END AS t FROM (SELECT *, CAST(unnest(range({_PARTS})) AS INTEGER) AS sub FROM {source}))"


DOC_ITEMS = "i0 AS (SELECT source AS grp, doc_id AS ord, COALESCE(text, '') AS t FROM documents)"


def _doc_items(spark, sf) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select(F.col("source").alias("grp"), F.col("doc_id").alias("ord"), F.coalesce("text", F.lit("")).alias("text"))


@query(f"WITH {DOC_ITEMS} SELECT grp, ord, sub, t AS text, CAST(length(t) AS INTEGER) AS len FROM {_expanded('i0')}")
def expand_oversize(spark, sf):
    return reduce.expand(_doc_items(spark, sf), BUDGET)


def _packed(x: str) -> str:
    """Greedy packing of items i<x> (grp, ord, t) as a recursive table p<x>, and its batches b<x>."""
    return f"""e{x} AS MATERIALIZED (SELECT grp, t, row_number() OVER (PARTITION BY grp ORDER BY ord, sub) AS pos FROM {_expanded(f'i{x}')}),
p{x} AS (SELECT grp, pos, t, 0 AS batch, length(t) AS size FROM e{x} WHERE pos = 1 UNION ALL
  SELECT e.grp, e.pos, e.t, CASE WHEN p.size + length(e.t) > {BUDGET} THEN p.batch + 1 ELSE p.batch END, CASE WHEN p.size + length(e.t) > {BUDGET} THEN length(e.t) ELSE p.size + length(e.t) END FROM p{x} p JOIN e{x} e ON e.grp = p.grp AND e.pos = p.pos + 1),
b{x} AS MATERIALIZED (SELECT grp, batch, string_agg(t, chr(10) || chr(10) ORDER BY pos) AS joined, SUM(length(t)) AS len FROM p{x} GROUP BY grp, batch)"""


def _reduced(x: str, answer: str, rounds: int = 4) -> str:
    """Rounds of reduction of items i<x>0 (grp, ord, t), unrolled: a table r<x> (grp, t).  answer: SQL of grp and joined."""
    out, done = [], []
    for k in range(rounds):
        y = f"{x}{k}"
        out.append(_packed(y))
        stop = "COUNT(*) OVER w = 1 OR SUM(length(t)) OVER w >= CAST(SUM(len) OVER w AS BIGINT) * 95 // 100"
        out.append(f"a{y} AS MATERIALIZED (SELECT *, {stop} AS stop FROM (SELECT grp, batch AS ord, {answer} AS t, len FROM b{y}) WINDOW w AS (PARTITION BY grp))")
        out.append(f"i{x}{k + 1} AS (SELECT grp, ord, t FROM a{y} WHERE NOT stop)")
        done.append(f"SELECT grp, string_agg(t, chr(10) || chr(10) ORDER BY ord) AS t FROM a{y} WHERE stop GROUP BY grp")
    return ",\n".join([*out, f"r{x} AS MATERIALIZED ({' UNION ALL '.join(done)})"])


@query(f"WITH RECURSIVE {DOC_ITEMS}, {_packed('0')} SELECT grp, CAST(pos AS INTEGER) AS pos, CAST(batch AS INTEGER) AS batch, CAST(length(t) AS INTEGER) AS len FROM p0")
def greedy_batches(spark, sf):
    packed = prefix.running(reduce.pack(reduce.expand(_doc_items(spark, sf), BUDGET), BUDGET), ["grp"], ["ord", "sub"], before=F.lit(1))
    return packed.select("grp", (F.col("before") + 1).cast("int").alias("pos"), "batch", "len")


@query(f"WITH RECURSIVE {DOC_ITEMS}, {_packed('0')} SELECT grp, COUNT(*) AS batches, sha256(string_agg(joined, chr(10) || chr(10) ORDER BY batch)) AS text_sha256 FROM b0 GROUP BY grp")
def loop_guard(spark, sf):
    """The echo never condenses: the guard ends each group after one round."""
    items = _doc_items(spark, sf)
    n = reduce.pack(reduce.expand(items, BUDGET), BUDGET).groupBy("grp").agg(F.countDistinct("batch").alias("batches"))
    out = reduce.reduce_items(items, BUDGET, lambda g, joined: Echo().complete(F.lit(""), joined))
    return out.select("grp", F.sha2("text", 256).alias("text_sha256")).join(n, "grp")


_SUMMED = "sha256('S' || chr(31) || joined)"


@query(f"""WITH RECURSIVE {DOC_ITEMS}, {_packed('0')}, i1 AS (SELECT grp, batch AS ord, {_SUMMED} AS t FROM b0), {_packed('1')}, i2 AS (SELECT grp, batch AS ord, {_SUMMED} AS t FROM b1), {_packed('2')},
n AS (SELECT grp, (SELECT COUNT(*) FROM b0 WHERE b0.grp = g.grp) AS n0, (SELECT COUNT(*) FROM b1 WHERE b1.grp = g.grp) AS n1, (SELECT COUNT(*) FROM b2 WHERE b2.grp = g.grp) AS n2 FROM (SELECT DISTINCT grp FROM i0) g)
SELECT grp, CASE WHEN n0 = 1 THEN (SELECT MIN({_SUMMED}) FROM b0 WHERE b0.grp = n.grp) WHEN n1 = 1 THEN (SELECT MIN({_SUMMED}) FROM b1 WHERE b1.grp = n.grp) WHEN n2 = 1 THEN (SELECT MIN({_SUMMED}) FROM b2 WHERE b2.grp = n.grp) END AS text FROM n""")
def reduce_fixpoint(spark, sf):
    """SQL unrolls three rounds, enough for 1,000 documents."""
    return reduce.reduce_items(_doc_items(spark, sf), BUDGET, lambda g, joined: Digest().complete(F.lit("S"), joined))


FENCED = "CASE doc_id % 6 WHEN 0 THEN '```json' || chr(10) || t || chr(10) || '```' WHEN 1 THEN ' ```markdown' || chr(10) || t || '```  ' WHEN 2 THEN '```go' || chr(10) || t || chr(10) || '```' WHEN 3 THEN '```a```' || t || '```c```' WHEN 4 THEN '``````' ELSE '  ' || t || chr(10) END"


@query(rf"""WITH t AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents), u AS (SELECT doc_id, trim({FENCED}, E' \t\n\r') AS u FROM t)
SELECT doc_id, CASE WHEN regexp_matches(u, '^`{{3,}}(?:markdown|json)?\s*(.*?)\s*`{{3,}}$', 's') THEN trim(regexp_extract(u, '^`{{3,}}(?:markdown|json)?\s*(.*?)\s*`{{3,}}$', 1, 's'), E' \t\n\r') ELSE u END AS text FROM u""")
def strip_fence(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    m, t = F.col("doc_id") % 6, F.col("t")
    f = F.when(m == 0, F.concat(F.lit("```json\n"), t, F.lit("\n```"))).when(m == 1, F.concat(F.lit(" ```markdown\n"), t, F.lit("```  "))).when(m == 2, F.concat(F.lit("```go\n"), t, F.lit("\n```")))
    f = f.when(m == 3, F.concat(F.lit("```a```"), t, F.lit("```c```"))).when(m == 4, "``````").otherwise(F.concat(F.lit("  "), t, F.lit("\n")))
    return d.select("doc_id", text.strip_fence(f).alias("text"))


STEPS = [("ONE", "p1"), ("TWO", "p2")]
STEP_ROWS = "s AS (SELECT * FROM (VALUES (0, 'ONE', 'p1'), (1, 'TWO', 'p2')) v(step_ord, step, prompt))"
ASKED = f"{STEP_ROWS}, a AS (SELECT path, dir, step_ord, step, idx, n_chunks, 'S' || chr(10) || prompt AS system, 'File: doc_' || doc_id || '.txt' || CASE WHEN n_chunks > 1 THEN ' (Chunk ' || (idx + 1) || ' of ' || n_chunks || ')' ELSE '' END || ' inside Module: ' || dir || chr(10) || '```' || chr(10) || chunk || chr(10) || '```' AS user FROM c CROSS JOIN s)"
ANSWER = "sha256(system || chr(31) || \"user\")"


@query(f"WITH {FILES}, {CHUNKS}, {ASKED} SELECT path, CAST(step_ord AS INTEGER) AS step_ord, step, idx, n_chunks, system, \"user\" FROM a")
def extraction_prompts(spark, sf):
    return facts.prompts(document_files(spark, sf), STEPS, "S", NUM_CTX)


_MERGED = "sha256('C' || chr(31) || 'Consolidate and deduplicate the extracted facts for ' || grp.path || ' regarding step ' || chr(39) || grp.step || chr(39) || ':' || chr(10) || joined)"
#: fc: an answer for each file and step; fa: the facts of each file.
FACTS = f"""{ASKED}, an AS MATERIALIZED (SELECT path, dir, step_ord, step, idx, n_chunks, {ANSWER} AS fact FROM a),
ix0 AS (SELECT {{'path': path, 'step_ord': step_ord, 'step': step}} AS grp, idx AS ord, fact AS t FROM an WHERE n_chunks > 1),
{_reduced("x", _MERGED)},
fc AS MATERIALIZED (SELECT path, step_ord, step, fact FROM an WHERE n_chunks = 1 UNION ALL SELECT grp.path, grp.step_ord, grp.step, t FROM rx),
fa AS MATERIALIZED (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '[^/]*$') AS name, rtrim(string_agg('#### [' || step || ']' || chr(10) || fact || chr(10) || chr(10), '' ORDER BY step_ord), chr(10)) AS facts FROM fc GROUP BY path)"""


def _consolidated(spark, sf) -> DataFrame:
    """Whole files.  The longest need several batches and rounds; tests hold them against a loop, too."""
    asked = facts.prompts(document_files(spark, sf), STEPS, "S", NUM_CTX)
    answers = asked.withColumn("fact", text.strip_fence(Digest().complete(F.col("system"), F.col("user")))).drop("system", "user")
    return facts.consolidate(answers, Digest(), "C", NUM_CTX)


@query(f"WITH RECURSIVE {FILES}, {CHUNKS}, {FACTS} SELECT path, CAST(step_ord AS INTEGER) AS step_ord, step, fact FROM fc")
def fact_consolidation(spark, sf):
    return _consolidated(spark, sf)


@query(f"WITH RECURSIVE {FILES}, {CHUNKS}, {FACTS} SELECT path, facts FROM fa")
def facts_assembly(spark, sf):
    return facts.assemble(_consolidated(spark, sf))


@query(f"WITH RECURSIVE {CUR}, {CHUNKS}, {FACTS} SELECT c.path, c.sha256, o.sha256 IS NOT NULL AS hit, CASE WHEN o.sha256 IS NOT NULL THEN 'facts of ' || c.path ELSE facts END AS facts FROM cur c JOIN fa USING (path) LEFT JOIN old o ON c.path = o.path AND c.sha256 = o.sha256")
def cache_hit_join(spark, sf):
    """Facts of all files: those of the last run where the hash is the same, others extracted."""
    source = TableFiles(_present(spark, sf))
    every, made = facts_of(source, source.index, _known(spark, sf), CONFIG, Digest())
    return every.join(made.select("path", F.lit(False).alias("hit")), "path", "left").select("path", "sha256", F.coalesce("hit", F.lit(True)).alias("hit"), "facts")


@query(f"WITH {FILES}, o AS (SELECT dir, 0 AS kind, 'doc_' || doc_id || '.txt' AS name, '### File: doc_' || doc_id || '.txt' || chr(10) || sha256 AS text FROM f WHERE doc_id % 7 <> 0), d AS (SELECT DISTINCT dir FROM f), u AS (SELECT split_part(dir, '/', 1) AS dir, 1 AS kind, split_part(dir, '/', 2) AS name, '### Subsystem: ' || split_part(dir, '/', 2) || chr(10) || 'sum of ' || dir AS text FROM d WHERE NOT ends_with(dir, 'fr')) SELECT * FROM o UNION ALL SELECT * FROM u")
def component_assembly(spark, sf):
    f = document_files(spark, sf)
    own = f.select("path", F.when(_doc_id() % 7 == 0, "").otherwise(F.col("sha256")).alias("facts"))
    kids = tree.directories(f).filter("depth = 2").select("path", F.when(F.col("path").endswith("fr"), "").otherwise(F.concat(F.lit("sum of "), "path")).alias("summary"))
    return facts.components(own, kids)


_SYNTHESIS = "sha256('S' || chr(10) || 'M' || chr(31) || 'Synthesize architecture for ' || grp || ':' || chr(10) || joined)"


def _level(x: str, below: str) -> str:
    """Summaries r<x> of the directories above those of r<below>."""
    parent, name = "CASE WHEN contains(grp, '/') THEN split_part(grp, '/', 1) ELSE '.' END", "regexp_extract(grp, '[^/]*$')"
    return f"i{x}0 AS (SELECT {parent} AS grp, {name} AS ord, '### Subsystem: ' || {name} || chr(10) || t AS t FROM r{below}),\n{_reduced(x, _SYNTHESIS)}"


MODULES = f"""{CHUNKS}, {FACTS},
iu0 AS (SELECT dir AS grp, name AS ord, '### File: ' || name || chr(10) || facts AS t FROM fa),
{_reduced("u", _SYNTHESIS)},
{_level("v", "u")},
{_level("w", "v")},
mods AS (SELECT grp AS path, t AS summary FROM ru UNION ALL SELECT grp, t FROM rv UNION ALL SELECT grp, t FROM rw)"""


@query(f"WITH RECURSIVE {FILES}, {MODULES} SELECT path, summary FROM mods")
def module_synthesis(spark, sf):
    """The first run from end to end, with files in many chunks and directories in several batches and rounds."""
    return reduce_tree(document_files(spark, sf), kept.empty(spark), CONFIG, Digest(), full=True).rebuilt


@query(f"WITH RECURSIVE {FILES}, {MODULES} SELECT p || '.md' AS page, sha256('S' || chr(10) || 'A' || chr(31) || 'Create ' || p || '.md. Base it on the root module summary:' || chr(10) || summary) AS text FROM mods, (SELECT unnest(['architecture', 'quickstart']) AS p) WHERE path = '.'")
def global_pages(spark, sf):
    root = module_synthesis(spark, sf).filter("path = '.'")
    return global_prompts(root, CONFIG).select("page", text.strip_fence(Digest().complete(F.col("system"), F.col("user"))).alias("text"))


@query(f"WITH {FILES}, {DIRS.format('f')} SELECT path, CASE WHEN path = '.' THEN 'README.md' ELSE path || '/README.md' END AS page FROM dirs")
def module_doc_path(spark, sf):
    return tree.directories(document_files(spark, sf)).select("path", paths.page(F.col("path")).alias("page"))


@query("WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN COALESCE(text, '') || chr(10) WHEN 2 THEN COALESCE(text, '') || chr(10) || chr(10) ELSE COALESCE(text, '') || CASE WHEN doc_id % 8 = 3 THEN 'AI Agent Guidelines' ELSE '' END END AS c FROM documents) SELECT doc_id, CASE WHEN c IS NULL THEN 'G' WHEN contains(c, 'AI Agent Guidelines') THEN c WHEN ends_with(c, chr(10) || chr(10)) THEN c || 'G' WHEN ends_with(c, chr(10)) THEN c || chr(10) || 'G' ELSE c || chr(10) || chr(10) || 'G' END AS content FROM t")
def guidelines_append(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    m, t = F.col("doc_id") % 4, F.coalesce("text", F.lit(""))
    c = F.when(m == 0, F.lit(None)).when(m == 1, F.concat(t, F.lit("\n"))).when(m == 2, F.concat(t, F.lit("\n\n"))).otherwise(F.concat(t, F.when(F.col("doc_id") % 8 == 3, MARKER).otherwise("")))
    return d.select("doc_id", text.guidelines(c, "G", MARKER).alias("content"))


@query("""WITH m AS (SELECT conv_id, string_agg('{"role":' || to_json(role) || ',"content":' || to_json(text) || '}', ',' ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id)
SELECT conv_id, '{"model":"m","messages":[{"role":"system","content":"S"},' || m || '],"stream":false,"options":{"num_ctx":512}}' AS request FROM m""")
def chat_request_json(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    m = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("m"))
    return m.select("conv_id", text.chat_request("m", F.lit("S"), F.col("m"), NUM_CTX).alias("request"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '' ELSE COALESCE(text, '') END AS reply FROM conversations")
def chat_response_extract(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    body = F.when(F.col("turn") % 3 == 2, F.lit(json.dumps({"message": {"role": "assistant"}}))).otherwise(F.to_json(F.struct(F.struct("role", F.coalesce("text", F.lit("")).alias("content")).alias("message"))))
    return c.select("conv_id", "turn", text.chat_reply(body).alias("reply"))


_CALLS = " UNION ALL ".join(["SELECT path FROM an", *(f"SELECT grp.path FROM ax{k}" for k in range(4)), *(f"SELECT grp FROM a{x}{k}" for x in "uvw" for k in range(4)), "SELECT unnest(['architecture.md', 'quickstart.md'])"])


@query(f"WITH RECURSIVE {FILES}, {MODULES}, calls AS ({_CALLS}) SELECT path, COUNT(*) AS calls FROM calls GROUP BY path")
def llm_call_plan(spark, sf):
    """Calls for each file, directory and global page of a first run with short answers."""
    return call_plan(document_files(spark, sf), CONFIG, Digest())


@query(f"WITH {CUR} SELECT path, sha256, 'facts of ' || path AS facts FROM old")
def cache_json_roundtrip(spark, sf):
    state = kept.State(_known(spark, sf), tree.directories(_present(spark, sf)).select("path", F.lit("s").alias("summary")), "h")
    return kept.from_json(kept.to_json(state)).files


@query(f"WITH RECURSIVE {FILES}, {MODULES} SELECT path, summary FROM mods".replace("FROM documents)", "FROM documents WHERE doc_id % 10 <> 0)", 1))
def incremental_update(spark, sf):
    """A first run over an older tree, then an update: the summaries equal those of a first run over the present one."""
    old = document_files(spark, sf).filter(_doc_id() % 10 != 2)
    old = old.select("path", "sha256", F.when(_doc_id() % 10 == 1, F.concat("content", F.lit("?"))).otherwise(F.col("content")).alias("content"), "error").withColumn("sha256", F.sha2("content", 256))
    first = reduce_tree(old, kept.empty(spark), CONFIG, Digest(), full=True)
    return reduce_tree(_present(spark, sf), first.state, CONFIG, Digest()).state.modules
