"""Secret scan: candidate strings, features as column expressions, and a random forest that removes false findings."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, WORD, whole

CORE = r"[A-Za-z0-9_+/=.\-]"
LEAST = 12  # characters of a candidate
CONTEXT = 256  # characters on either side that count as neighbours of a candidate
CHUNK = 256  # words of a text, or pieces of a word, that are looked at together
MAX_LABELLED = 20_000  # labelled findings that a forest is fitted on, at most; drawn by a digest
TREES, DEPTH = 20, 6

KEYWORDS = r"(?i)(secret|token|passw(or)?d|pwd|api[_-]?key|access[_-]?key|auth|credential)"
HARMLESS = r"(?i)(example|sample|test|dummy|placeholder|changeme|mail|version|issue|page|isbn|card|phone|call)"
DIGESTS = r"(?i)(commit|revision|checksum|digest|sha-?[0-9]*|md5|hash|blob|etag)"
# Access keys, tokens and signed claims that their form gives away.
TOKENS = (r"^((AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}|xox[abeprs]-[A-Za-z0-9\-]{10,}|"
          r"sk-[A-Za-z0-9_\-]{20,}|[rs]k_(live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35}|npm_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]*)$")
# Words whose presence inside a candidate speaks against randomness.
DICTIONARY = (
    "the and for with from that this example test sample user name mail http https www com org net file data page index image "
    "version default config local server client admin public private null true false value string number date time year month "
    "der die und ein ich les des une que para los por con"
).split()
FEATURES = ["length", "digits", "letters", "uppers", "hexadecimal", "distinct", "transitions", "coverage", "path_test", "path_config", "keyword_before", "harmless_before", "assigned", "quoted", "token_form"]


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, path, start, candidate, before, after): strings of at least 12 letters, digits and ``_+/=.-`` with a digit.

    start is the code point where the candidate begins. before holds the three words ahead and what precedes the candidate in
    its own word, the last CONTEXT characters of it; after what follows up to the next run of candidate characters, CONTEXT at most. A ``name=value`` without quotes is split, so that the name stands before its value, if the
    value is long enough; a shorter one stays whole. Null texts have none. Rows are independent, so repeated rows repeat their candidates.
    """
    text = whole()
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), text.alias("text"))
    rows = rows.filter(F.col("text").rlike(rf"{CORE}*[0-9]{CORE}*") & F.col("text").rlike(rf"{CORE}{{{LEAST},}}"))
    lead = F.char_length("text") - F.char_length(F.regexp_replace("text", f"^[{SPACE}]+", ""))
    rows = rows.select("doc_id", "path", lead.alias("lead"), F.regexp_extract_all("text", F.lit(f"{WORD}[{SPACE}]*"), F.lit(0)).alias("words"))
    # Words are taken CHUNK at a time with the three before them, and so are the pieces of one long word: what a candidate costs
    # is bounded by the chunk, not by the text.
    rows = chunks(rows, "words", 3).withColumn("lead", F.col("lead") + F.col("base")).drop("base")
    long = lambda w: (F.char_length(w) >= LEAST) & w.rlike(rf"(?=[^\s]*[0-9]){CORE}{{{LEAST},}}")
    at = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: (i > F.col("ahead_n")) & long(F.try_element_at("words", i)))
    rows = rows.withColumn("i", F.explode(at))
    ahead = F.slice("words", F.greatest(F.col("i") - 3, F.lit(1)), F.least(F.col("i") - 1, F.lit(3)))
    skipped = F.slice("words", F.col("ahead_n") + 1, F.col("i") - 1 - F.col("ahead_n"))
    start = F.aggregate(skipped, F.col("lead"), lambda n, w: n + F.char_length(w))
    rows = rows.select("doc_id", "path", F.element_at("words", F.col("i")).alias("word"), F.right(F.array_join(ahead, ""), F.lit(CONTEXT)).alias("ahead"), start.alias("at"))
    # runs of candidate characters and what lies between them, in order with a running offset: every occurrence has its own place
    rows = rows.select("doc_id", "path", "ahead", "at", F.regexp_extract_all("word", F.lit(rf"{CORE}+|[^{CORE[1:-1]}]+"), F.lit(0)).alias("pieces"))
    rows = chunks(rows, "pieces", CONTEXT, 1)
    fits = lambda p: (F.char_length(p) >= LEAST) & p.rlike("[0-9]") & p.rlike(f"^{CORE}")
    here = F.filter(F.sequence(F.lit(1), F.size("pieces")), lambda i: (i > F.col("ahead_n")) & (i <= F.size("pieces") - F.col("behind_n")) & fits(F.try_element_at("pieces", i)))
    rows = rows.withColumn("i", F.explode(here))
    before = F.slice("pieces", F.greatest(F.col("i") - CONTEXT, F.lit(1)), F.least(F.col("i") - 1, F.lit(CONTEXT)))
    inside = F.aggregate(F.slice("pieces", F.col("ahead_n") + 1, F.col("i") - 1 - F.col("ahead_n")), F.col("base"), lambda n, p: n + F.char_length(p))
    after = F.when(F.col("i") < F.size("pieces"), F.left(F.try_element_at("pieces", F.col("i") + 1), F.lit(CONTEXT))).otherwise(F.lit(""))
    rows = rows.select(
        "doc_id", "path", (F.col("at") + inside).cast("bigint").alias("start"), F.element_at("pieces", F.col("i")).alias("candidate"),
        F.right(F.concat("ahead", F.array_join(before, "")), F.lit(CONTEXT)).alias("before"), after.alias("after"))
    return split_names(rows)


def chunks(rows: DataFrame, items: str, ahead: int, behind: int = 0) -> DataFrame:
    """One row per CHUNK strings of the array ``items``, with up to ``ahead`` strings before them and ``behind`` after them.

    Adds base (characters before the chunk), ahead_n and behind_n (strings that belong to the neighbours). An empty array has no row.
    """
    n = F.ceil(F.size(items) / CHUNK).cast("int")
    numbers = F.sequence(F.lit(0), n - 1)
    sizes = F.transform(numbers, lambda c: F.aggregate(F.slice(items, c * CHUNK + 1, F.lit(CHUNK)), F.lit(0).cast("bigint"), lambda k, w: k + F.char_length(w)))

    def part(c: Column, sizes: Column) -> Column:
        lead, after = F.least(c * CHUNK, F.lit(ahead)), F.size(items) - c * CHUNK
        tail = F.least(F.lit(behind), F.greatest(after - CHUNK, F.lit(0)))
        base = F.aggregate(F.slice(sizes, F.lit(1), c), F.lit(0).cast("bigint"), lambda k, v: k + v)
        return F.struct(base.alias("base"), lead.alias("ahead_n"), tail.alias("behind_n"), F.slice(items, c * CHUNK + 1 - lead, lead + F.least(F.lit(CHUNK), after) + tail).alias(items))

    # the sizes are bound to a name, so that they are added up once; rows carry their chunk and not the whole array
    parts = F.transform(F.array(sizes), lambda s: F.transform(numbers, lambda c: part(c, s)))[0]
    others = [c for c in rows.columns if c != items]
    return rows.filter(F.size(items) > 0).select(*others, F.explode(parts).alias("_part")).select(*others, "_part.*")


def split_names(rows: DataFrame) -> DataFrame:
    """Takes ``name=value`` apart at the last ``=`` that is no padding; a name that could be a secret itself stays a candidate too."""
    head = F.regexp_extract("candidate", r"^(.*=)[^=]", 1)
    value, name = F.substring("candidate", F.char_length(head) + 1, F.char_length("candidate")), F.regexp_replace(head, "=+$", "")
    fits = lambda c: (F.char_length(c) >= LEAST) & c.rlike("[0-9]")
    part = lambda skip, c, before, after: F.struct((F.col("start") + skip).alias("start"), c.alias("candidate"), before.alias("before"), after.alias("after"))
    whole_one = part(F.lit(0), F.col("candidate"), F.col("before"), F.col("after"))
    value_one = part(F.char_length(head), value, F.concat("before", head), F.col("after"))
    name_one = part(F.lit(0), name, F.col("before"), F.left(F.concat(F.substring("candidate", F.char_length(name) + 1, F.lit(CONTEXT)), "after"), F.lit(CONTEXT)))
    parts = F.when(~((head != "") & fits(value)), F.array(whole_one)).when(fits(name), F.array(name_one, value_one)).otherwise(F.array(value_one))
    rows = rows.select("doc_id", "path", F.explode(parts).alias("p"))
    return rows.select("doc_id", "path", F.col("p.start").alias("start"), "p.candidate", "p.before", F.rtrim("p.after").alias("after"))


def features(found: DataFrame) -> DataFrame:
    """Adds the columns FEATURES: length, character classes and transitions, dictionary coverage, path and neighbouring words."""
    c, n = F.col("candidate"), F.char_length("candidate").cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    flag = lambda test: test.cast("double")
    low = F.lower(c)
    covered = reduce(lambda a, b: a + b, [F.when(low.contains(w), float(len(w))).otherwise(0.0) for w in DICTIONARY])
    changes = r"(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    columns: dict[str, Column] = {
        "length": n, "digits": share("[0-9]"), "letters": share("[A-Za-z]"), "uppers": share("[A-Z]"), "hexadecimal": flag(c.rlike("^[0-9a-fA-F]+$")),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n, "transitions": share(changes), "coverage": F.least(covered / n, F.lit(1.0)),
        "path_test": flag(F.col("path").rlike("(?i)(test|spec|example|doc|sample)")), "path_config": flag(F.col("path").rlike(r"(?i)(\.env|config|settings|\.ya?ml|\.ini|\.properties)")),
        "keyword_before": flag(F.col("before").rlike(KEYWORDS)), "harmless_before": flag(F.col("before").rlike(HARMLESS)),
        "assigned": flag(F.col("before").rlike(rf"[=:][{SPACE}]*[\"'`]?$")), "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "token_form": flag(c.rlike(TOKENS)),
    }
    return found.withColumns(columns)


def fit(labelled: DataFrame, most: int = MAX_LABELLED, seed: int = 7) -> RandomForestClassificationModel | None:
    """A forest fitted on at most ``most`` labelled findings (candidates with an integer ``label``), drawn by a digest; null labels
    are left out. None if there is none of either label."""
    rows = features(labelled.filter("label is not null")).select(*FEATURES, F.col("label").cast("double").alias("label"), F.md5(F.concat_ws("|", "candidate", "before", "after")).alias("draw"))
    rows = rows.orderBy("draw", *FEATURES).limit(most).persist()
    try:
        if rows.select("label").distinct().count() < 2:
            return None
        ready = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(rows)
        return RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(ready)
    finally:
        rows.unpersist()


def score(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Adds ``score`` (share of the forest for a secret) and ``secret`` (0.5 or more). Without a model every candidate scores 0.5
    and stays a finding."""
    if model is None:
        return found.withColumns({"score": F.lit(0.5), "secret": F.lit(True)})
    made = VectorAssembler(inputCols=FEATURES, outputCol="vector", handleInvalid="keep").transform(features(found))
    voted = model.transform(made).withColumn("score", vector_to_array("probability")[1])
    return voted.select(*found.columns, "score", (F.col("score") >= 0.5).alias("secret"))


def verified(found: DataFrame) -> DataFrame:
    """Labels the findings that can be told without a model; the others have a null label and teach nothing.

    1: tokens of a known form, and values assigned to a name with a keyword (quoted or not) that are hexadecimal or base-64 of 32
    or more characters, or have 16 or more with letters, two digits and no words. 0: without keyword or known form, numbers and
    dates, what is mostly words, what follows a harmless word, and digests that are named as such.
    """
    c, n = F.col("candidate"), F.char_length("candidate")
    key = F.col("before").rlike(rf"{KEYWORDS}[A-Za-z0-9_.\-]*[\"'`]?[{SPACE}]*[=:]+>?[{SPACE}]*[\"'`]?$")
    strict = c.rlike(r"^([0-9a-fA-F]{32,}|[A-Za-z0-9+/]{32,}={0,2})$")
    low = F.lower(c)
    covered = reduce(lambda a, b: a + b, [F.when(low.contains(w), len(w)).otherwise(0) for w in DICTIONARY if len(w) > 3])
    mixed = (n >= 16) & c.rlike("[A-Za-z]") & (F.regexp_count(c, F.lit("[0-9]")) >= 2) & (covered == 0)
    known = c.rlike(TOKENS)
    harmless = F.col("before").rlike(HARMLESS)
    numbers = c.rlike(r"^[0-9_+/=.\-]+$")
    digest = c.rlike("^[0-9a-fA-F]+$") & F.col("before").rlike(rf"{DIGESTS}[^A-Za-z0-9]*$")
    clear = ~known & ~F.col("before").rlike(KEYWORDS) & (numbers | (covered * 3 >= n) | harmless | digest)
    return found.withColumn("label", F.when(known | (key & (strict | (mixed & ~harmless))), 1).when(clear, 0).cast("int"))
