"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are runs of at least 16 characters of keys, whatever they are made of; values of at least six
signs that are assigned to a credential's name; and the heads of private keys. One pass over a text marks
them; a split at the marks gives the candidates and the text between them, all of which is kept.
Each candidate is described by its length, its character transitions, how much of it dictionary words
cover, its likeness to a path, and the words around it. The transitions' probabilities are learned from
the whole texts of all documents, with and without candidates, but for the candidates themselves, so that a
candidate that reads like its surroundings is told from a random one. A random forest trained from labelled findings decides. All of it runs on the
JVM: patterns, counts and features are SQL expressions, the forest is MLlib's.

The labelled findings that come with the operator are made by rule, `LABELLED` of them, from kinds of
credentials and kinds of strings that look like them, with words of their own besides some of the dictionary;
a team's own can be given instead, as (before, candidate, after, label).

Defined cases: null and empty texts have no candidates; every candidate of a text is a row, also if
it repeats; null labels are ignored, and so are findings without a candidate; training findings of one
label only make every decision that label; a control character U+0001 in a text counts as a space; only
doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkbase.llm.common import materialize

#: Fixed number of labelled findings made by rule.
LABELLED = 6000
MARK = "\x01"
KEY = r"A-Za-z0-9+/_~.\-"
#: A credential's name with an assignment ($1) and its value ($2); or a run of key characters, or a private key's head ($3).
CANDIDATE = (
    r"""((?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_\- ]?key|credential)s?["']?\s{0,3}[:=]\s{0,3}["']?)([^\s"'<>,;]{6,}+)"""
    rf"""|((?<![{KEY}])[{KEY}]{{16,}}+={{0,2}}|-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----)"""
)
#: Characters of the text before and after a candidate that are shown with it and described.
BEFORE, AFTER = 200, 60
#: Common parts of names and paths.
DICTIONARY = (
    "access account address admin api app archive article asset auth backup base bin block blog body build cache case chart "
    "check class client code commit common component conf config content core count data date default demo dev device dir "
    "doc document domain download example export feature field file final find font form format forum group guide head "
    "help home html http https icon image img import index info input item java key label language lib library license "
    "list local log login mail main manual map master media menu message model module name net network new node note "
    "number object old option order org output package page parameter part path photo placeholder plugin post print "
    "product profile project public query read record release report request resource result review root sample script "
    "search section secret server service session setting settings site source src start state static status store style "
    "system table tag task team temp template test text theme thread time title token tool topic type update upload url "
    "user utils value version video view web wiki window word work www your"
).split()
CREDENTIAL = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential)"
BENIGN = r"(?i)(commit|sha\d|md5|hash|checksum|digest|uuid|guid|build|version|revision|example|sample|dummy|placeholder|page|file|path|http|www|order|invoice|isbn|card|call)"
FEATURES = [
    "length", "digits", "upper", "kind_changes", "case_changes", "distinct", "longest_letters", "hex", "transitions", "covered", "path_signs",
    "extension", "named", "credential_word", "benign_word", "assigned", "closed_quote",
]
#: The characters whose transitions are counted, after lower-casing.
SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789"


@dataclass
class SecretModel:
    forest: RandomForestClassificationModel
    #: log2 of the probability of each character after each, row by row in the order of `SIGNS`.
    transitions: list[float]


def _share(pattern: str, of: Column) -> Column:
    return F.regexp_count(of, F.lit(pattern)).cast("double") / F.greatest(F.length(of), F.lit(1))


# ---------------------------------------------------------------- candidates


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, pieces) of all documents with a text: text and candidates by turns, both whole."""
    whole = F.regexp_replace(F.translate("text", MARK, " "), CANDIDATE, f"$1{MARK}$2$3{MARK}")
    return materialize(docs.filter(F.col("text").isNotNull()).select("doc_id", F.split(whole, MARK, -1).alias("pieces")))


def candidates(pieces: DataFrame) -> DataFrame:
    """(doc_id, finding, before, candidate, after) of every candidate, numbered within its text."""
    at = F.sequence(F.lit(0), F.shiftright(F.size("pieces") - 3, 1))
    piece = lambda i: F.get("pieces", i)
    each = F.transform(
        at,
        lambda i: F.struct(
            F.substring(piece(2 * i), -BEFORE, BEFORE).alias("before"), piece(2 * i + 1).alias("candidate"), F.substring(piece(2 * i + 2), 1, AFTER).alias("after")
        ),
    )
    found = pieces.filter(F.size("pieces") > 1)
    return found.select("doc_id", F.posexplode(each).alias("finding", "found")).select("doc_id", "finding", "found.*")


def learn_transitions(pieces: DataFrame) -> list[float]:
    """Transitions of the text outside candidates, over all documents; one is added to each count."""
    texts = F.filter("pieces", lambda p, i: i % 2 == 0)
    words = pieces.select(F.explode(F.regexp_extract_all(F.lower(F.array_join(texts, " ")), F.lit("[a-z0-9]{2,}"), F.lit(0))).alias("word"))
    words = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    pairs = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("pair"))
    found = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}  # 1,296 at most
    out = []
    for a in SIGNS:
        counts = [found.get(a + b, 0) + 1 for b in SIGNS]
        out += [math.log2(c / sum(counts)) for c in counts]
    return out


# ---------------------------------------------------------------- features


def features(findings: DataFrame, transitions: list[float]) -> DataFrame:
    """The findings (before, candidate, after) with one double column for each feature."""
    c, before, after = F.col("candidate"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    low = F.lower(c)
    runs = F.regexp_extract_all(low, F.lit("[a-z]{3,}"), F.lit(0))
    known = F.array(*map(F.lit, DICTIONARY))
    covered = F.aggregate(F.filter(runs, lambda w: F.array_contains(known, w)), F.lit(0), lambda n, w: n + F.length(w))
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), F.length)), F.lit(0))
    # Mean over neighbouring letters and digits; each character's place among the signs is told by its code.
    code = F.transform(F.split(F.regexp_replace(low, "[^a-z0-9]", ""), ""), lambda x: F.when(x <= "9", F.ascii(x) - 48 + 26).otherwise(F.ascii(x) - 97))
    table = F.lit(transitions)
    # An array of one, so that the codes are made once and not for every step.
    steps = F.flatten(
        F.transform(
            F.array(code),
            lambda own: F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(own) - 2, F.lit(0))),
                lambda i: F.coalesce(F.get(table, F.get(own, i) * len(SIGNS) + F.get(own, i + 1)), F.lit(0.0)),
            ),
        )
    )
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    return findings.withColumns(
        {
            "length": F.length(c).cast("double"),
            "digits": _share("[0-9]", c),
            "upper": _share("[A-Z]", c),
            "kind_changes": _share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", c),
            "case_changes": _share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])", c),
            "distinct": F.size(F.array_distinct(F.split(c, ""))).cast("double") / F.least(F.length(c), F.lit(40)),
            "longest_letters": longest.cast("double"),
            "hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
            "transitions": F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(steps), F.lit(1)),
            "covered": covered.cast("double") / F.greatest(F.length(c), F.lit(1)),
            "path_signs": _share(r"[/.\-]", c),
            "extension": flag(c.rlike(r"\.[a-z]{2,5}$") | before.rlike("(://|/|@)$")),
            "named": flag(c.rlike("^(AKIA|ASIA|gh[pousr]_|xox[baprs]-|sk-|sk_live_|AIza|eyJ|-----BEGIN)")),
            "credential_word": flag(before.rlike(CREDENTIAL)),
            "benign_word": flag(before.rlike(BENIGN)),
            "assigned": flag(before.rlike(r"""([:=]\s*["'`]?|(?i)bearer\s+)$""")),
            "closed_quote": flag(after.rlike("""^["'`]""")),
        }
    )


# ---------------------------------------------------------------- labelled findings

#: Words of the strings made by rule, none of which is in the dictionary.
VOCABULARY = (
    "river mountain garden silver lattice harbour orchard violet thunder marble candle meadow falcon copper winter saffron "
    "lantern pebble cactus ribbon walnut glacier tundra velvet compass anchor timber quartz willow ember"
).split()


def labelled_findings(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """(before, candidate, after, label, kind): made by rule; half are credentials, half are strings that look like them."""
    i = F.col("id")
    draw = lambda salt, n: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(n)).cast("int")
    pick = lambda values, salt: F.get(F.array(*map(F.lit, values)), draw(salt, len(values)))
    word = lambda salt: pick(VOCABULARY, salt)
    name = lambda salt: F.when(draw(salt + 500, 3) == 0, pick(DICTIONARY, salt)).otherwise(word(salt))
    sha1, sha2, md5 = F.sha1(i.cast("string")), F.sha2(i.cast("string"), 256), F.md5(i.cast("string"))
    b64 = F.regexp_replace(F.base64(F.unhex(sha2)), "=", "")
    mixed = F.regexp_replace(b64, "[+/]", "k")
    letters = F.translate(F.lower(F.concat(mixed, mixed)), "0123456789", "qwzxjvkypg")
    lead = F.concat_ws(" ", word(11), word(12), F.lit(""))
    opened = pick(['="', ": '", "=", ": ", " = \"", " := "], 1)
    owner = pick(["password", "passwd", "DB_SECRET", "client_secret", "ACCESS_KEY", "api_key", "auth_token", "credential", "private key", "SIGNING_KEY"], 2)
    bare = pick(["my key is ", "use ", "Authorization: Bearer ", "login with ", "the secret was "], 3)
    held = F.concat(lead, F.when(draw(4, 5) == 0, bare).otherwise(F.concat(owner, opened)))
    secrets = [
        F.substring(sha2, 1, 48), md5, F.upper(F.substring(sha2, 1, 32)), F.substring(b64, 1, 43), F.concat(F.substring(mixed, 1, 10), F.lit("."), F.substring(mixed, 11, 27)),
        F.concat(F.lit("hf_"), F.substring(letters, 1, 34)), F.concat(F.lit("AKIA"), F.upper(F.substring(mixed, 1, 16))), F.concat(F.lit("xoxb-"), F.substring(sha2, 1, 11), F.lit("-"), F.substring(mixed, 1, 24)),
        F.concat(F.initcap(word(21)), (i % 90 + 10).cast("string"), F.lit("!"), word(22)), F.concat(word(23), F.lit("-"), (i % 9000).cast("string")), F.lit("-----BEGIN RSA PRIVATE KEY-----"),
    ]
    uuid = F.regexp_replace(md5, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    year = (F.pmod(i, F.lit(40)) + 1985).cast("string")
    number = F.lpad(F.pmod(F.xxhash64(i, F.lit(5)), F.lit(10**15)).cast("string"), 17, "7")
    other = F.concat(lead, pick(["commit ", "etag: ", "revision=", "sha256:", "md5sum ", "checksum = \"", "build "], 31))
    lookalikes = [
        (other, F.substring(sha2, 1, 40)), (other, F.concat(sha2, F.lit(""))), (F.concat(lead, pick(["request id ", "uuid=", "trace: "], 32)), uuid), (F.concat(lead, pick(["phone ", "invoice ", "", "order: "], 33)), number),
        (F.concat(lead, pick(["https://", "see /", "from ./"], 34)), F.concat_ws("/", name(41), name(42), F.concat(name(43), year), F.concat(name(44), F.lit(".html")))),
        (lead, F.concat_ws("-", name(45), year, name(46), name(47))), (lead, F.concat(F.initcap(name(48)), F.initcap(name(49)), F.initcap(name(50)), F.lit("Handler"))),
        (F.concat(lead, owner, opened), F.concat_ws("_", F.lit("your"), name(51), F.lit("here"))), (F.concat(lead, owner, opened), pick(["xxxxxxxxxxxx", "changeme", "********", "${VALUE}", "undefined", "required"], 52)),
        (F.concat(lead, owner, opened), F.repeat(F.substring(md5, 1, 2), 12)), (lead, F.concat(word(53), word(54), word(55))), (F.concat(lead, F.lit("contact@")), F.concat_ws(".", F.concat(name(56), name(57)), F.lit("org"))),
        (lead, F.concat_ws(".", F.lit("org"), name(58), name(59), F.concat(name(60), F.lit("Test")))), (F.concat(lead, F.lit("data:image/png;base64,")), F.concat(F.lit("iVBORw0KGgo"), mixed, mixed)),
    ]
    label = (i % 2).cast("int")
    kind = F.when(label == 1, draw(6, len(secrets))).otherwise(draw(6, len(lookalikes)) + 100)
    which = lambda options: F.coalesce(*(F.when(kind == k, o) for k, o in options))
    candidate = which([*enumerate(secrets), *((100 + k, c) for k, (_, c) in enumerate(lookalikes))])
    before = which([*((k, held) for k in range(len(secrets))), *((100 + k, b) for k, (b, _) in enumerate(lookalikes))])
    made = spark.range(rows).select(before.alias("before"), candidate.alias("candidate"), label.alias("label"), kind.alias("kind"), i)
    last = F.substring("before", -1, 1)
    return made.select("before", "candidate", F.concat(F.when(last.isin('"', "'"), last).otherwise(F.lit("")), pick([" ", ", ", "\n", ". "], 7)).alias("after"), "label", "kind")


def train(findings: DataFrame, transitions: list[float], trees: int = 24, depth: int = 8, seed: int = 7) -> SecretModel:
    """A forest from labelled findings (before, candidate, after, label 0 or 1)."""
    rows = features(findings.filter(F.col("label").isin(0, 1) & F.col("candidate").isNotNull()), transitions)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows).select("_features", F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(vectors)
    return SecretModel(forest, transitions)


def judge(findings: DataFrame, model: SecretModel) -> DataFrame:
    """The findings with the forest's probability and is_secret (from 0.5)."""
    kept = findings.columns
    described = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(features(findings, model.transitions))
    # A forest that has seen label 0 only knows one class.
    judged = model.forest.transform(described).withColumn("probability", F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)))
    return judged.select(*kept, "probability", (F.col("probability") >= 0.5).alias("is_secret"))


def scan(docs: DataFrame, findings: DataFrame | None = None, redact: bool = True) -> DataFrame:
    """(doc_id, finding, before, candidate, after, probability, is_secret) of every candidate.

    `findings` are a team's labelled ones; without, those made by rule. With `redact`, a secret is shown by its
    first four characters, its length and the start of its SHA-256, as a scan's results shouldn't spread it.
    """
    spark = docs.sparkSession
    pieces = marked(docs.select("doc_id", "text"))
    labelled = findings if findings is not None else labelled_findings(spark)
    model = train(materialize(labelled.select("before", "candidate", "after", "label")), learn_transitions(pieces))
    judged = judge(candidates(pieces), model)
    if not redact:
        return judged
    hidden = F.concat(F.substring("candidate", 1, 4), F.lit("..."), F.length("candidate").cast("string"), F.lit(":"), F.substring(F.sha2("candidate", 256), 1, 16))
    return judged.withColumn("candidate", F.when(F.col("is_secret"), hidden).otherwise(F.col("candidate")))
