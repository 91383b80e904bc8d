"""Secrets in texts: candidates by pattern, false positives removed by a random
forest trained on labelled findings. DataFrame functions and MLlib only.

A candidate is the first that matches at a place of: the head of a private key;
a signed token of three parts; what is assigned to a name such as password,
token or api_key, of 6 characters or more; a run of 16 or more letters, digits
and +/_- with a digit among them, closed by one or two = if they end it. A name
before = is no part of a run's value. Its features are length, changes between
character classes, entropy, shares of classes, how much of it a dictionary
covers, the path it is in, and the words around it.

Defined results: a null or empty text has no candidate; a null path is an empty
one; repeated rows are scanned each, and equal values in one text are candidates
each; null keys are carried, keys may have any type; an empty table gives an
empty result; other columns, whatever their names, are ignored; texts and runs
of any length are read whole; of findings that tie for the last of `most`
training rows, any may be used. Values are given as SHA-256, never as they stand.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

#: Names whose values are looked at whatever they are made of. Fixed values.
SECRET_NAMES = "api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|client[_-]?secret|auth[_-]?token|token|secret|passwd|password|passphrase|pwd|credentials?"
PRIVATE_KEY = "-----BEGIN [A-Z ]*PRIVATE KEY-----"
SIGNED = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
#: What precedes is looked at from the nearest mark outwards, so that most places cost one character.
ASSIGNED = rf"(?<=[:=\x20\"'])(?<=[:=]\x20?[\"']?)(?<![\w.$-])(?<=(?i:{SECRET_NAMES})[\"']?\x20?[:=]\x20?[\"']?)[^\s\"'`,;&<>()\[\]{{}}:=]{{6,}}+={{0,2}}"
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
CANDIDATE = f"{PRIVATE_KEY}|{SIGNED}|{ASSIGNED}|{RUN}"
#: How tokens begin that their issuers mark. Fixed values.
ISSUED = r"^(xox[abeprs]-|gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|AKIA|ASIA|AIza|npm_|hf_|pypi-|dop_v1_|SG\.|EAAC|ya29\.)"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Words that make up identifiers and paths rather than keys. Fixed values.
DICTIONARY = (
    "access account action admin alpha api app apply archive asset auth auto back base beta block board body build button cache card case category "
    "center chain change channel check class client cloud code color column comment common config content control copy core count create custom data "
    "date default delete demo deploy detail device dialog disk document download edit editor email end error event example export field file filter "
    "final find first font form format front full function get global graph group handler head header height history home host http image import index "
    "info init input install item job key label language last layer layout left length level library line link list load local location log login main "
    "manager map master menu message meta method mobile mode model module name new next node note null number object offset old open option order page "
    "panel parent part password path pattern plain player plugin point post preview primary print private process product profile project property "
    "public query queue read record red release remote render report request reset resource response result right role root row rule sample save scale "
    "scheme screen script search section secret select server service session set setting share shell size sort source stack start state status step "
    "store string style submit sub summary support sync system table tag target task team template test text theme thread time title token tool top "
    "total track tree type unit update upload url user util value version video view web week width window word work write xml year zone"
).split()

FEATURES = [
    "length", "changes", "entropy", "digits", "upper", "lower", "marks", "hex", "distinct", "covered", "in_path", "test_path", "key_word", "hash_word",
    "assigned", "quoted", "key_head", "signed", "issued", "uuid",
]
#: Characters on each side that the neighbouring words are taken from.
CONTEXT = 128
_BLOCK = 256


def _starts(steps: Column) -> Column:
    """Running sums of steps (g: before, n: own length) up to each one's own
    begin. Blocks of steps are added up first, so the work is n * _BLOCK."""
    width = F.lit(_BLOCK)
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda t, x: t + x["g"] + x["n"])

    def with_bases(bases: Column) -> Column:
        def start(x: Column, i: Column) -> Column:
            block = F.floor(i / width).cast("int")
            return F.get(bases, block) + total(F.slice(steps, block * width + 1, i - block * width)) + x["g"]

        return F.transform(steps, start)

    blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / width).cast("int"))
    sums = F.transform(blocks, lambda b: total(F.slice(steps, b * width + 1, width)))
    bases = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda out, s: F.concat(out, F.array(F.element_at(out, -1) + s)))
    return let(bases, with_bases)


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, start, end (code points), before, candidate, after, path of each candidate."""
    t = F.col(text)
    place = F.lit("") if path is None else F.coalesce(F.col(path).cast("string"), F.lit(""))

    def cut(found: Column, gaps: Column) -> Column:
        """gaps[i] stands before found[i]."""
        steps = F.transform(found, lambda c, i: F.struct(F.length(F.get(gaps, i)).alias("g"), F.length(c).alias("n")))
        return let(let(steps, _starts), lambda starts: F.transform(found, lambda c, i: F.struct(
            F.get(starts, i).alias("start"), F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), c.alias("candidate"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after"),
        )))

    found = let(F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)), lambda found: F.when(F.size(found) > 0, let(F.split(t, CANDIDATE, -1), lambda gaps: cut(found, gaps))))
    rows = docs.select(F.col(key).alias("key"), place.alias("path"), F.explode(found).alias("c"))
    return rows.select("key", "path", "c.*", (F.col("c.start") + F.length("c.candidate")).alias("end"))


def with_features(found: DataFrame) -> DataFrame:
    """found (before, candidate, after, path) with FEATURES as doubles."""
    c, n = F.col("candidate"), F.greatest(F.length("candidate"), F.lit(1)).cast("double")
    count = lambda pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    letters = F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    times = lambda x: (F.length(c) - F.length(F.replace(c, x, F.lit("")))) / n
    bits = F.aggregate(letters, F.lit(0.0), lambda total, x: total + let(times(x), lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)))
    fragments = F.split(F.lower(F.regexp_replace(c, r"([a-z])([A-Z])", r"$1 $2")), "[^a-z]+")
    known = F.array(*map(F.lit, DICTIONARY))
    covered = F.aggregate(fragments, F.lit(0), lambda total, w: total + F.when(F.array_contains(known, w), F.length(w)).otherwise(0)) / n
    before, after = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    return found.withColumns({
        "length": n, "changes": count(r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]") / n,
        "entropy": bits, "digits": count("[0-9]") / n, "upper": count("[A-Z]") / n, "lower": count("[a-z]") / n, "marks": count("[^A-Za-z0-9]") / n,
        "hex": flag(c.rlike("^[0-9a-fA-F]+$")), "distinct": F.size(letters) / n, "covered": covered,
        "in_path": flag(before.rlike(r"(://\S*|[/\\.])$") & ~before.rlike(r"=$") | after.rlike(r"^[./\\]\w") | c.contains("/") & c.rlike("[a-z]{4,}/")),
        "test_path": flag(F.lower("path").rlike(r"test|example|sample|fixture|mock|lock|\.md")),
        "key_word": flag(before.rlike(r"(?i)(api.?key|token|secret|passw|pwd|passphrase|credential|auth|bearer|private|access.?key|\bkey)\W{0,6}\w{0,12}\W{0,6}$")),
        "hash_word": flag(before.rlike(r"(?i)(sha-?\d*|md5|commit|checksum|digest|hash|uuid|guid|etag|revision|build|example|dummy|\bid|isbn|order|card|phone)\W{0,6}\w{0,12}\W{0,6}$")),
        "assigned": flag(before.rlike(r"[=:]\s*[\"'`]?$")), "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")), "key_head": flag(c.startswith("-----BEGIN")), "signed": flag(c.rlike(f"^{SIGNED}$")),
        "issued": flag(c.rlike(ISSUED)), "uuid": flag(c.rlike(UUID)),
    })


def example_findings(spark: SparkSession, rows: int = 8000) -> DataFrame:
    """Labelled findings for a start, made by rule: keys, tokens and passwords as
    code, shells, settings and addresses hold them, and the usual false alarms
    (digests, commits, identifiers, paths, card and order numbers, prose and
    placeholders after a name), in files of many kinds."""
    i = F.col("id")
    hexes, more = F.sha2(F.concat(F.lit("a"), i), 256), F.sha2(F.concat(F.lit("b"), i), 256)
    b64 = F.translate(F.base64(F.unhex(hexes)), "=", "")
    of = lambda words, salt: F.get(F.array(*map(F.lit, words)), F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(words))).cast("int"))
    word, word2 = of(DICTIONARY, 1), of(DICTIONARY, 2)
    name = of(["token", "api_key", "secret", "password", "access_key", "auth_token"], 5)
    quote = F.when(F.pmod(F.xxhash64(i), F.lit(3)) > 0, F.lit('"')).otherwise(F.lit(""))
    loose = F.when(F.pmod(F.xxhash64(i, F.lit(3)), F.lit(2)) == 0, F.lit(" = ")).otherwise(F.lit(": "))
    digits = F.translate(F.substring(more, 1, 40), "abcdef", "012345")
    letters = F.translate(more, "0123456789", "ghkmnpqrst")
    size = (F.lit(24) + F.pmod(F.xxhash64(i, F.lit(4)), F.lit(40))).cast("int")
    row = lambda before, text, after, label: F.struct(F.concat(before).alias("before"), F.concat(text).alias("candidate"), F.concat(after).alias("after"), F.lit(label).alias("label"))
    assigned, text = F.concat(word2, F.lit(" "), name, loose, quote), F.lit
    uuid = F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))
    of_kind = lambda a, b: F.when(F.pmod(F.xxhash64(i, F.lit(13)), F.lit(2)) == 0, a).otherwise(F.translate(b, "+/", "xY"))
    shell = F.concat(text("export "), F.upper(F.concat(word, text("_"), name)), text("="))
    made = [
        row(assigned, F.substring(hexes, 1, 40), quote, 1.0), row(assigned, F.left(hexes, size), quote, 1.0), row(assigned, b64, quote, 1.0),
        row(assigned, F.concat(text("AKIA"), F.upper(F.substring(hexes, 1, 16))), quote, 1.0), row(assigned, F.concat(text("sk_live_"), F.left(b64, F.lit(24))), quote, 1.0),
        row(F.concat(word, text(" ")), F.concat(text("ghp_"), F.left(F.translate(b64, "+/", "xY"), F.lit(36))), text(" "), 1.0),
        row(text("\n"), text("-----BEGIN RSA PRIVATE KEY-----"), text("\n"), 1.0),
        row(shell, F.left(b64, size), text("\n"), 1.0), row(shell, F.substring(hexes, 1, 40), text("\n"), 1.0),
        row(F.concat(text("https://host.example/"), word, text("?"), name, text("=")), F.substring(hexes, 1, 32), text("&page=2"), 1.0),
        row(F.concat(text("authorization bearer ")), F.concat(text("eyJ"), F.left(b64, F.lit(20)), text("."), F.left(F.translate(more, "+/", "xY"), F.lit(30)), text("."), F.left(letters, F.lit(20))), text(" "), 1.0),
        row(F.concat(of(["Authorization: Bearer ", "authorization: bearer ", "-H 'Authorization: Token "], 11)), F.left(of_kind(hexes, b64), size), text("\n"), 1.0),
        row(F.concat(word, text(" ")), F.concat(of(["xoxb-", "xoxp-", "glpat-", "github_pat_", "sk-", "npm_", "hf_", "AIza", "dop_v1_"], 12), F.substring(digits, 1, 11), F.left(F.translate(b64, "+/", "xY"), F.lit(24))), text(" "), 1.0),
        row(F.concat(name, text("_id"), loose, quote), uuid, quote, 0.0), row(F.concat(word, text("_uuid"), loose, quote), uuid, quote, 0.0), row(F.concat(text("request "), word, text(" ")), uuid, text(" "), 0.0),
        row(assigned, F.left(letters, F.pmod(i, F.lit(20)).cast("int") + 12), quote, 1.0),
        row(assigned, F.concat(word, F.left(letters, F.lit(4)), word2, F.substring(digits, 1, 2), text("!")), quote, 1.0),
        row(assigned, F.concat(F.left(letters, F.lit(5)), text("#"), F.substring(digits, 1, 4), text("$"), F.right(letters, F.lit(3))), quote, 1.0),
        row(text("commit "), F.substring(hexes, 1, 40), text("\n"), 0.0), row(F.concat(word, text(" sha256:")), hexes, text(" "), 0.0), row(F.concat(text("checksum"), loose, quote), F.md5(hexes), quote, 0.0),
        row(F.concat(word, text(" id"), loose), F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 12)), text(" "), 0.0),
        row(F.concat(word, text(" ")), F.concat_ws("_", word, word2, text("settings"), F.pmod(i, F.lit(90)).cast("string")), text(" "), 0.0),
        row(text("https://host.example/"), F.concat_ws("/", word, word2, F.substring(hexes, 1, 12)), text(" "), 0.0),
        row(F.concat(word, text(" ")), F.substring(digits, 1, 16), text(" "), 0.0), row(F.concat(word, text(" ")), F.concat(text("2024-01-02-build-"), F.substring(digits, 1, 6)), text(" "), 0.0),
        row(F.concat(text("for "), word, text(" ")), F.concat(word, word2, text("Handler"), F.substring(digits, 1, 2), word), text(". "), 0.0),
        row(F.concat(text("the "), name, text(": ")), F.concat(word, of(["", "s", "ed", "ing"], 6)), text(" is "), 0.0), row(assigned, F.concat(text("your_"), word, text("_"), word2), quote, 0.0),
        row(F.concat(name, text(" = ")), F.concat(text("os.environ.get_"), word), text("("), 0.0), row(F.concat(name, text(": ")), of(["string", "required", "optional", "changeme", "undefined", "integer", "boolean", "xxxxxxxx", "********"], 7), text("\n"), 0.0),
        row(F.concat(name, text(" = ")), F.concat(word, text("."), word2, text("."), word), text("\n"), 0.0),
    ]
    chosen = spark.range(rows).select("id", F.get(F.array(*made), F.pmod(i, F.lit(len(made))).cast("int")).alias("f"))
    plain, trial = of(["src/app/settings.py", "deploy/prod.env", "conf/main.yml", "web/index.html", ""], 8), of(["tests/fixtures/data.json", "docs/example.md", "package-lock.json", "mock/server.py"], 9)
    in_trial = F.pmod(F.xxhash64(i, F.lit(10)), F.lit(10)) < F.when(F.col("f.label") > 0, 1).otherwise(5)
    return chosen.select("id", "f.*", F.when(in_trial, trial).otherwise(plain).alias("path"))


def train(findings: DataFrame, most: int = 50_000, trees: int = 24, depth: int = 9, seed: int = 7) -> RandomForestClassificationModel:
    """A forest from labelled findings (before, candidate, after, path, label).
    `most` bounds the labelled rows used; beyond it, those with the lowest hash."""
    rows = findings.orderBy(F.xxhash64("before", "candidate", "after")).limit(most)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(rows)).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=2).fit(vectors)


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, key: str = "doc_id", text: str = "text", path: str | None = "source", least: float = 0.5) -> DataFrame:
    """key, start, end, value_sha256, p_secret and is_secret for each candidate.
    findings: labelled ones to learn from; none: those made by rule."""
    model = train(example_findings(docs.sparkSession) if findings is None else findings)
    found = with_features(candidates(docs, key, text, path))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    p = vector_to_array("probability")[1]
    return scored.select(
        F.col("key").alias(key), "start", "end", F.sha2(F.col("candidate").cast("binary"), 256).alias("value_sha256"), F.round(p, 6).alias("p_secret"), (p >= least).alias("is_secret")
    )
