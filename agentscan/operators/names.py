"""Names that imitate known ones: a deletion-neighbourhood index joined by equality, then the distance.

Two strings at most d edits apart have a string in common among those that each leaves after deleting
up to d of its letters. So both sides are spread into these strings, which are joined by equality; no
pair is compared that shares none, and the known names may be any number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentscan.functions.rules import quoted
from agentscan.operators.configs import KNOWN
from agentscan.sources.derived import pick, read, sql_pick

#: Edits at most that make a name near.
MOST = 2


def deletions(name: Column, most: int = MOST) -> Column:
    """The distinct strings that ``name`` leaves after deleting up to ``most`` letters, itself among them."""
    found = F.array(name)
    for _ in range(most):
        found = F.array_distinct(F.flatten(F.transform(found, lambda s: F.concat(F.array(s), F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.left(s, i - 1), F.substring(s, i + 1, F.length(s))))))))
    return found


def lookalikes(names: DataFrame, known: DataFrame, most: int = MOST) -> DataFrame:
    """(name, uses, known, distance): names that are not known but at most ``most`` edits from a known one.

    ``names`` and ``known`` hold a column ``name``. Names are counted before anything is spread, so one
    that a third of all rows hold is one row, and so are repeats of known ones; nulls and the empty
    name take no part. A name that is known itself imitates nothing. Of known names at the same, least
    distance the one first in code-point order is given; the distance counts code points. A deletion
    string that many names share (of two letters, say) meets only names of nearly its own length, as
    both sides may leave out ``most`` letters at most. Either table may be empty. Both joins are sorted
    merges: a name is spread into some hundred strings, which the planner does not know when it takes a
    small table's index for one that fits the driver.
    """
    asked = names.where("name <> ''").groupBy("name").agg(F.count("*").alias("uses"))
    # spreading is the work: a small table of names is dealt to all tasks for it
    goods = known.where("name <> ''").select("name").distinct().repartition(4 * names.sparkSession.sparkContext.defaultParallelism, "name")
    odd = asked.join(goods.hint("merge"), "name", "left_anti")
    left = odd.select("name", "uses", F.explode(deletions(F.col("name"), most)).alias("cut"))
    right = goods.select(F.col("name").alias("known"), F.explode(deletions(F.col("name"), most)).alias("cut"))
    # the distance is taken where pairs meet, and the least is kept before the shuffle: pairs that share many strings are not sent
    pairs = left.hint("merge").join(right.hint("merge"), "cut").where(F.abs(F.length("name") - F.length("known")) <= most)
    near = pairs.withColumn("distance", F.levenshtein("name", "known", most)).where("distance BETWEEN 1 AND {}".format(most))
    best = near.groupBy("name", "uses").agg(F.min(F.struct("distance", "known")).alias("b"))
    return best.select("name", "uses", "b.known", "b.distance")


#: Endings of package names, one by id, so that known names number as many as the parts.
ENDINGS = ("tool", "server", "agent", "skill", "client")
#: Edits of names, one by id: % stands for a name's first half, & for its second.
EDITS = ("%&", "%x&", "%-&", "x%&y", "%&", "%&s", "%--&zz", "%&", "_%&")


def known_names(spark, sf_dir: str) -> DataFrame:
    """The registry: the known servers, and a package for every part."""
    p = read(spark, sf_dir, "part").select(F.concat_ws("-", F.concat(F.lit("pkg"), F.col("p_partkey").cast("string")), pick(ENDINGS, F.col("p_partkey"))).alias("name"))
    return p.unionByName(spark.createDataFrame([(k,) for k in KNOWN], "name string"))


def requested_names(spark, sf_dir: str) -> DataFrame:
    """What files ask for: every document names a package of the registry, now and then misspelt, or a known server."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    key = F.col("doc_id") % 997 + 1
    plain = F.when(F.col("doc_id") % 4 == 0, pick(KNOWN, F.floor(F.col("doc_id") / 4))).otherwise(F.concat_ws("-", F.concat(F.lit("pkg"), key.cast("string")), pick(ENDINGS, key)))
    half = F.floor(F.length(plain) / 2).cast("int")
    made = F.replace(F.replace(pick(EDITS, F.col("doc_id")), F.lit("%"), F.left(plain, half)), F.lit("&"), F.substring(plain, half + 1, F.length(plain)))
    return d.select("doc_id", made.alias("name"))


def q_lookalikes(spark, sf_dir):
    """Packages that files ask for under a name one or two edits from a known one."""
    return lookalikes(requested_names(spark, sf_dir), known_names(spark, sf_dir))


SQL_LOOKALIKES = f"""WITH goods AS (SELECT DISTINCT 'pkg' || p_partkey || '-' || {sql_pick(ENDINGS, "p_partkey")} AS known FROM part UNION SELECT unnest([{", ".join(map(quoted, KNOWN))}])),
d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN {sql_pick(KNOWN, "doc_id // 4")} ELSE 'pkg' || (doc_id % 997 + 1) || '-' || {sql_pick(ENDINGS, "(doc_id % 997 + 1)")} END AS plain FROM documents),
n AS (SELECT replace(replace({sql_pick(EDITS, "doc_id")}, '%', left(plain, (length(plain) // 2)::INT)), '&', substring(plain, (length(plain) // 2 + 1)::INT)) AS name FROM d),
asked AS (SELECT name, count(*) AS uses FROM n GROUP BY name),
near AS (SELECT name, uses, known, levenshtein(name, known)::INT AS distance FROM asked, goods WHERE abs(length(name) - length(known)) <= {MOST} AND levenshtein(name, known) BETWEEN 1 AND {MOST} AND name NOT IN (SELECT known FROM goods)),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, known) AS k FROM near)
SELECT name, uses, known, distance FROM r WHERE k = 1"""

QUERIES = {"name_lookalikes": (q_lookalikes, SQL_LOOKALIKES)}
