"""Groups of spelling variants by PartEnum signatures of letter multisets.

A word's letters, each numbered by its occurrence, are a binary vector: one inserted or deleted letter
changes it in one place, a replaced one in two. Vectors at Hamming distance of at most DISTANCE agree in
all but DISTANCE of any partition's parts: the alphabet is dealt to FIRST groups, of which some group
holds at most its share of the differences, and each group to SECOND parts, of which all but that many
agree. A signature names the group, the parts that are kept, and the letters in them; words with a
common signature are joined by equality and verified letter by letter. So no two near words are missed.

Parts are balanced by the words that hold each letter. A signature that more than BUCKET words have is
refined by what a single edit leaves equal: the word less one letter, or, for long words, one half of it.
All of it is DataFrame functions.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentscan.llm.common import written

DISTANCE = 2
FIRST, SECOND = 1, 7
#: Words of one signature that are compared with each other as they are.
BUCKET = 256
#: The longest word that is refined by leaving out each letter; longer ones are refined by halves.
SHORT = 64
#: A run is a word's occurrence; the letters of a word are [a-zÀ-ÿ] then.
RUN = "[A-Za-zÀ-ÿ]{%d,}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", at_least: int = 6, often: int = 5, slip: int = 199) -> DataFrame:
    """word, n: words of ``at_least`` letters with ``often`` occurrences, with planted slips of the pen.

    A run whose checksum with its document's id is divisible by ``slip`` has lost the letter that the
    checksum names. A null id is written as nothing, a null text has no runs; repeated rows count each.
    """
    run = F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(RUN % at_least), F.lit(0))).alias("run")
    runs = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("doc"), run)
    ascii_only = F.octet_length("run") == F.length("run")
    runs = runs.select("doc", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    runs = runs.withColumn("sum", F.crc32(F.concat("doc", F.lit(":"), "run")))
    word = F.when(F.col("sum") % slip == 0, F.overlay("run", F.lit(""), (F.col("sum") % F.length("run") + 1).cast("int"), F.lit(1))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= at_least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def _letters(word: Column) -> Column:
    return F.array_sort(F.array_distinct(F.split(word, "")))


def _parts(words: DataFrame, count: int) -> tuple[str, str]:
    """The letters, and for each the character that names its part: dealt to and fro, the most common first."""
    held = words.select(F.explode(_letters(F.col("word"))).alias("letter")).groupBy("letter").count()
    ordered = [r["letter"] for r in held.orderBy(F.desc("count"), "letter").collect() if r["letter"]]  # an alphabet: 90 letters at most
    there = [i if (k // count) % 2 == 0 else count - 1 - i for k, i in ((k, k % count) for k in range(len(ordered)))]
    return "".join(ordered), "".join(chr(ord("A") + p) for p in there)


def signatures(words: DataFrame, first: int | None = None, second: int | None = None) -> DataFrame:
    """``words`` once for each of their signatures (``signature`` long)."""
    first, second = first or FIRST, second or SECOND
    letters, parts = _parts(words, first * second)
    differ = DISTANCE // first
    word = F.col("word")
    size = F.length("word")
    # the letters of a part and how often they occur: the ones of the vector in it
    counted = F.transform(_letters(word), lambda x: F.struct(F.translate(x, letters, parts).alias("part"), F.concat(x, (size - F.length(F.replace(word, x, F.lit("")))).cast("string")).alias("ones")))
    held = words.withColumn("counted", counted)

    def ones_of(p: int) -> Column:
        return F.array_join(F.transform(F.filter("counted", lambda c: c["part"] == chr(ord("A") + p)), lambda c: c["ones"]), "")

    ones = F.array(*[ones_of(p) for p in range(first * second)])
    held = held.withColumn("ones", ones).drop("counted")
    kept = [(g, parts_) for g in range(first) for parts_ in itertools.combinations(range(second), second - differ)]
    names = F.array(*[F.xxhash64(F.lit(i), *[F.col("ones")[g * second + p] for p in chosen]) for i, (g, chosen) in enumerate(kept)])
    return held.withColumn("signature", F.explode(names)).drop("ones")


def _refined(signature: Column, word: Column) -> Column:
    """Keys of which two words of one signature, a single edit apart, have one in common."""
    size = F.length(word)
    less = F.concat(F.array(word), F.transform(F.sequence(F.lit(1), size), lambda i: F.overlay(word, F.lit(""), i.cast("int"), F.lit(1))))
    shorter = F.when(size <= SHORT + 1, F.transform(less, lambda x: F.xxhash64(signature, x))).otherwise(F.array().cast("array<bigint>"))
    lengths = F.array(size, size - 1)  # the shorter word's length is the word's or one less
    half = lambda n: F.floor(n / 2).cast("int")
    front = F.transform(lengths, lambda n: F.xxhash64(signature, n, F.lit("front"), F.substring(word, F.lit(1), half(n))))
    back = F.transform(lengths, lambda n: F.xxhash64(signature, n, F.lit("back"), F.substring(word, size - (n - half(n)) + 1, n - half(n))))
    longer = F.when(size >= SHORT, F.concat(front, back)).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(shorter, longer))


def _one_edit(a: Column, b: Column) -> Column:
    """Whether one letter inserted, deleted or replaced makes ``b`` of ``a``; long words by their first difference."""
    more = F.length(a) - F.length(b)
    at = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y)), F.lit(True)).cast("int")
    rest = lambda w, skip: F.substring(w, at + skip, F.length(w))
    by_rest = F.when(more == 0, rest(a, F.lit(1)) == rest(b, F.lit(1))).when(more < 0, rest(a, F.lit(0)) == rest(b, F.lit(1))).otherwise(rest(a, F.lit(1)) == rest(b, F.lit(0)))
    return (F.abs(more) <= 1) & F.when(F.length(a) <= SHORT, F.levenshtein(a, b, 1) == 1).otherwise(by_rest)


def near_words(words: DataFrame) -> DataFrame:
    """word, other, other_n: all words that one inserted, deleted or replaced letter makes of each other, both ways."""
    signed = written(signatures(words.select("word", "n")), "signed")
    large = written(signed.groupBy("signature").count().where(F.col("count") > BUCKET).select("signature", F.lit(True).alias("large")), "large")
    dealt = signed.join(large, "signature", "left")
    keys = F.when(F.col("large"), _refined(F.col("signature"), F.col("word"))).otherwise(F.array("signature"))
    keyed = written(dealt.select("word", "n", F.explode(keys).alias("key")), "keyed")
    other = keyed.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = keyed.join(other, "key").where((F.col("word") < F.col("other")) & _one_edit(F.col("word"), F.col("other"))).select("word", "n", "other", "other_n").distinct()
    pairs = written(pairs, "near")
    return pairs.select("word", "other", "other_n").unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def _roots(forms: DataFrame, rounds: int) -> DataFrame:
    """word, root: the end of each word's chain of forms; every round doubles the steps taken."""
    reached = forms.select("word", F.col("form").alias("root"))
    for i in range(rounds):
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        reached = written(reached.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"roots-{i}")
    return reached


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", times: int = 5, **counting) -> DataFrame:
    """word, form, root, n, n_near, form_n: each word with the far more common word that it may be a variant of.

    A word's form is its near word of most occurrences, the smallest in code-point order among those of
    equally many, if it has ``times`` as many as the word; root is where the forms' forms end, the word
    itself without any. ``counting``: see ``word_counts``, which also says what becomes of nulls and
    repeated rows. Long texts and words are read whole; an empty table gives no words; other columns,
    whatever their names, are ignored.
    """
    words = written(word_counts(docs, doc_id, text, **counting), "words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    formed = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "formed")
    forms = formed.where("form is not null")
    # counts grow at least ``times``-fold from form to form, so that chains are short
    most = words.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most, times)) + 1) if times > 1 else most
    roots = _roots(forms, math.ceil(math.log2(steps)) + 1)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
