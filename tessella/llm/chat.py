"""Reply-ordered conversations from quoted messages, in built-in functions only.

The quote level of a line is the number of ``>`` before its text.  Lines of
one level in a row are a passage.  A passage, with case, punctuation and line
breaks normalised, is hashed and joined to the earlier messages of the same
conversation that have it as their whole own text, a paragraph or a line; of
several the latest counts.  Of a trimmed passage its paragraphs are looked for
in the same way, and then its lines.  A message replies to what its least quoted
passage comes from, or else to the message before it.  Its text is what is
left without quotes and the line that announces them.

A message carries on the branch of the one that it replies to if it is the
first to do so, and else starts a branch.  In the order of branch (named by
its first turn) and turn every message follows the one that it replies to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

BLOCK = 4096
_LEAD = r"^[ \t]*(>[ \t]*)*"
_ANNOUNCE = r"(?i)^[ \t]*on .*wrote:[ \t]*$"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _before(rows: DataFrame, keys: list[str], mark: str, name: str) -> DataFrame:
    """``rows`` with the largest ``mark`` among those of smaller turn and equal keys.

    Keys are cut into blocks of turns: within a block by a window, from the
    blocks before by a window over one row for each.
    """
    cut = rows.withColumn("_block", F.floor(F.col("turn") / BLOCK))
    inside = Window.partitionBy(*keys, "_block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy(*keys, "_block").agg(F.max(mark).alias("_most")).select(*keys, "_block", F.max("_most").over(ahead).alias("_carried"))
    own = cut.withColumn("_own", F.max(mark).over(inside))
    return own.join(carried, [*keys, "_block"]).withColumn(name, F.coalesce("_own", "_carried")).drop("_block", "_own", "_carried")


def conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role and own text of every row, reply_to (a turn), quoted (found by a quote) and branch.

    Null texts count as empty; messages that are all quote have an empty
    text; a row repeated, or several with one turn, share what is found for
    that turn; rows without conversation or turn reply to nothing and have
    no branch; an empty table gives no rows; other columns are left alone.
    """
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n")
    level = lambda line: F.length(F.regexp_replace(F.regexp_extract(line, _LEAD, 0), "[^>]", ""))
    cut = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.split(clean, "\n").alias("lines"))
    cut = cut.withColumn("levels", F.transform("lines", lambda x: level(x)))
    announced = lambda x, i: x.rlike(_ANNOUNCE) & (F.coalesce(F.try_element_at("levels", i + 2), F.lit(0)) > 0)
    own = F.filter("lines", lambda x, i: (F.element_at("levels", i + 1) == 0) & ~announced(x, i))
    cut = cut.withColumn("own", F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", ""))
    said = cut.where("conv IS NOT NULL AND turn IS NOT NULL")

    # Equal rows would give a passage each line several times.
    quoting = said.where(F.exists("levels", lambda n: n > 0)).select("conv", "turn", "lines", "levels").distinct()
    quoting = quoting.select("conv", "turn", F.xxhash64("lines").alias("_row"), F.posexplode(F.arrays_zip("lines", "levels")).alias("at", "x"))
    by_line = Window.partitionBy("conv", "turn", "_row").orderBy("at")
    runs = quoting.select("*", F.col("x.levels").alias("level")).withColumn("_new", (F.coalesce(F.lag("level").over(by_line), F.lit(-1)) != F.col("level")).cast("int")).withColumn("run", F.sum("_new").over(by_line))
    bare = F.regexp_replace(F.col("x.lines"), _LEAD, "")
    passages = runs.where("level > 0").groupBy("conv", "turn", "_row", "run", "level").agg(F.array_sort(F.collect_list(F.struct("at", bare.alias("line")))).alias("part"))
    body = F.array_join(F.col("part.line"), "\n")
    # What a passage is found by: 0 the whole of it, 1 one of its paragraphs, 2 one of its lines.
    graded = lambda grade, x: F.transform(x, lambda p: F.struct(F.lit(grade).alias("grade"), normal(p).alias("norm")))
    wanted = [graded(n, x) for n, x in enumerate((F.array(body), F.split(body, r"\n\s*\n"), F.split(body, "\n")))]
    passages = passages.select("conv", "turn", "level", F.explode(F.concat(*wanted)).alias("_w")).where("_w.norm <> ''")
    passages = stored(passages.groupBy("conv", "turn", "level", F.xxhash64("_w.norm").alias("hash")).agg(F.min("_w.grade").alias("grade")), "passages")
    split_up = F.array_distinct(F.concat(F.array("own"), F.split("own", r"\n\s*\n"), F.split("own", "\n")))
    pieces = said.join(passages.select("conv").distinct(), "conv", "left_semi").select("conv", "turn", F.explode(F.transform(split_up, lambda x: normal(x))).alias("norm")).where("norm <> ''")
    known = pieces.select("conv", "turn", F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("grade"), F.xxhash64("norm").alias("hash")).distinct().join(passages.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
    events = known.withColumn("mark", F.col("turn")).unionByName(passages.withColumn("mark", F.lit(None).cast("long")))
    found = _before(events, ["conv", "hash"], "mark", "_from").where("level IS NOT NULL AND _from IS NOT NULL")
    links = found.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("nearness"), (-F.col("grade")).alias("wholeness"), F.col("_from").alias("to"))).alias("_link")).select("conv", "turn", F.col("_link.to").alias("_to"))

    turns = said.select("conv", "turn").distinct().withColumn("mark", F.col("turn"))
    placed = _before(turns, ["conv"], "mark", "_last").join(links, ["conv", "turn"], "left")
    placed = stored(placed.select("conv", "turn", F.coalesce("_to", "_last").alias("reply_to"), F.col("_to").isNotNull().alias("quoted"), "_last"), "replies")
    first = placed.where("reply_to IS NOT NULL").groupBy("conv", "reply_to").agg(F.min("turn").alias("_first"))
    carried = placed.join(first, ["conv", "reply_to"], "left").withColumn("_carries", F.coalesce(F.col("turn") == F.col("_first"), F.lit(False)))
    # Turns that carry on from the turn just before are one run with it; only heads of runs are followed upwards.
    mark = F.when(~(F.col("_carries") & (F.col("reply_to") == F.col("_last"))), F.col("turn"))
    chained = stored(_before(carried.withColumn("mark", mark), ["conv"], "mark", "_earlier").select("conv", "turn", "reply_to", "quoted", "_carries", F.coalesce("mark", "_earlier").alias("head")), "runs")
    to = chained.select("conv", F.col("turn").alias("reply_to"), F.col("head").alias("up"))
    up = stored(chained.where("turn = head AND _carries").select("conv", "head", "reply_to").join(to, ["conv", "reply_to"]).select("conv", "head", "up"), "branches")
    # A head that isn't in ``up`` starts its branch.
    while True:
        above = up.select("conv", F.col("head").alias("up"), F.col("up").alias("_above"))
        after = stored(up.join(above, ["conv", "up"], "left").select("conv", "head", F.coalesce("_above", "up").alias("up"), F.col("_above").isNotNull().alias("_moved")), "branches")
        up = after.select("conv", "head", "up")
        if after.where("_moved").isEmpty():
            break
    placed = chained.join(up, ["conv", "head"], "left").select("conv", "turn", "reply_to", "quoted", F.coalesce("up", "head").alias("branch"))
    out = cut.join(placed, ["conv", "turn"], "left")
    return out.select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.col("own").alias(text), "reply_to", F.coalesce("quoted", F.lit(False)).alias("quoted"), "branch")


ORACLE = r"""
WITH RECURSIVE cut AS (
  SELECT conv_id AS conv, turn, role, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM conversations
), marked AS (
  SELECT *, list_transform(lines, lambda x: length(regexp_replace(regexp_extract(x, '^[ \t]*(>[ \t]*)*'), '[^>]', '', 'g'))) AS levels FROM cut
), owned AS (
  SELECT *, regexp_replace(array_to_string(list_filter(lines, lambda x, i: levels[i] = 0 AND NOT (regexp_matches(x, '(?i)^[ \t]*on .*wrote:[ \t]*$') AND coalesce(levels[i + 1], 0) > 0)), chr(10)), '^\s+|\s+$', '', 'g') AS own FROM marked
), each_ AS (
  SELECT conv, turn, lines AS row_, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line, unnest(levels) AS level FROM owned
), stepped AS (
  SELECT *, CASE WHEN lag(level) OVER w IS DISTINCT FROM level THEN 1 ELSE 0 END AS new FROM each_ WINDOW w AS (PARTITION BY conv, turn, row_ ORDER BY pos)
), runs AS (
  SELECT *, sum(new) OVER (PARTITION BY conv, turn, row_ ORDER BY pos) AS run FROM stepped
), passages AS (
  SELECT DISTINCT conv, turn, level, trim(regexp_replace(lower(string_agg(regexp_replace(line, '^[ \t]*(>[ \t]*)*', ''), ' ' ORDER BY pos)), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm
  FROM runs WHERE level > 0 GROUP BY conv, turn, row_, run, level
), pieces AS (
  SELECT DISTINCT conv, turn, trim(regexp_replace(lower(unnest(list_concat([own], string_split_regex(own, '\n\s*\n'), string_split(own, chr(10))))), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM owned
), links AS (
  SELECT p.conv, p.turn, p.level, max(o.turn) AS origin FROM passages p JOIN pieces o ON o.conv = p.conv AND o.norm = p.norm AND o.turn < p.turn WHERE p.norm <> '' GROUP BY ALL
), best AS (
  SELECT conv, turn, origin FROM (SELECT *, row_number() OVER (PARTITION BY conv, turn ORDER BY level, origin DESC) AS k FROM links) WHERE k = 1
), turns AS (
  SELECT conv, turn, lag(turn) OVER (PARTITION BY conv ORDER BY turn) AS last FROM (SELECT DISTINCT conv, turn FROM owned)
), placed AS (
  SELECT t.conv, t.turn, coalesce(b.origin, t.last) AS reply_to, b.origin IS NOT NULL AS quoted FROM turns t LEFT JOIN best b ON b.conv = t.conv AND b.turn = t.turn
), parents AS (
  SELECT *, turn = min(turn) OVER (PARTITION BY conv, reply_to) AND reply_to IS NOT NULL AS carries FROM placed
), walked AS (
  SELECT conv, turn, turn AS branch FROM parents WHERE NOT carries
  UNION ALL SELECT p.conv, p.turn, w.branch FROM walked w JOIN parents p ON p.conv = w.conv AND p.reply_to = w.turn AND p.carries
)
SELECT o.conv AS conv_id, o.turn, o.role, o.own AS text, p.reply_to, p.quoted, w.branch
FROM owned o JOIN placed p ON p.conv = o.conv AND p.turn = o.turn JOIN walked w ON w.conv = o.conv AND w.turn = o.turn
"""
