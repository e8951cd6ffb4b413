"""Secret scans: a random forest tells secrets from other long tokens. DataFrame and SQL functions only.

Candidates are tokens of documents with enough letters and digits, values that are assigned to a word (shorter ones too,
and without digits), long ones without digits beside a secret word or with a known prefix, values with any printable
marks that are given to a secret word, passwords in URLs, and passphrases. Their features
are length, transitions between kinds of characters, coverage by dictionary words, the path, and the neighbouring words.
The forest learns from labelled findings; synthetic_findings() makes such a table by rules, and a table of reviewed
findings with the same columns can take its place.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Shortest value that is a candidate, and shortest one that is assigned to a word.
MIN_LENGTH = 12
MIN_ASSIGNED = 6
#: Words on either side that count as neighbours.
NEIGHBOURS = 3
#: Rows of the synthetic findings.
FINDINGS = 6000

#: Prefixes that issuers give their keys.
KNOWN_PREFIX = "^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abpr]-|sk_live_|rk_live_|AIza|eyJ|SG\\.)"
#: Words near a secret, and words near something else.
SECRET_WORDS = "(?i)(token|secret|passw|pwd|credential|api.?key|access.?key|auth|bearer|private|signing)"
OTHER_WORDS = "(?i)(commit|sha|md5|hash|uuid|guid|version|checksum|digest|example|dummy|sample|placeholder|order|invoice|card|phone|tracking|isbn|build)"
OTHER_PATH = "(?i)(test|example|sample|fixture|mock|docs?/|readme|lock)"
#: A small dictionary for coverage.
DICTIONARY = "account|address|admin|change|client|config|customer|data|default|development|document|example|file|hello|invoice|item|local|name|number|order|page|password|placeholder|product|public|sample|secret|server|service|string|system|table|test|token|user|value|version|world|your|the|and|ing|tion|ment"

#: Words that give a value to the word before them, ends of the names of passphrases, and words of plain sentences, which no passphrase has.
GIVES = ("is", "was")
PHRASE_NAMES = "(?i)(phrase|mnemonic)[\"']?"
SENTENCE_WORDS = "\\b(the|and|that|not|never|with|for|this|must|should|will|can|has|had|been|was|are|you|your|from|only|when|which|but)\\b"
#: A passphrase: 4 to 24 words of small letters.
PHRASE_WORDS = 24
_PHRASE = "^[\"']?([a-z]{3,}(?:[ -][a-z]{3,}){3,23})(?![a-z])"
#: Marks that may stand in a value given by name in the same token, and at least one that no piece has.
_NAMED = "^[\"'(\\[{<]*([A-Za-z_.\\-]+)[\"']?(?::?=|:)[\"']?([A-Za-z0-9_+/.\\-=!@#$%^*~?|]+?)[\"')\\]}>]*[,;.]*$"
_MARKS = "[!@#$%^*~?|]"
_URL_PASSWORD = "(://[^/@:\\s]*:)([^/\\s]+)@"

#: The pieces that tile a token: runs of a value's characters (with = as padding only), and what is between them.
_PIECES = "[A-Za-z0-9_+/.\\-]++(?:={1,2}(?![A-Za-z0-9_+/.\\-=\"']))?|[^A-Za-z0-9_+/.\\-]++"

FEATURES = ("length", "digits", "uppers", "lowers", "signs", "transitions", "distinct", "longest_run", "covered", "hex", "known_prefix", "near_secret", "near_other", "assigned", "other_path", "words")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate: id, position (of its token), part (of the token), value, left, right (neighbours), path, assigned.

    Tokens are divided by white space, and every run of a value's characters in a token counts: part is its number among
    the token's pieces, and the piece before it (a name, if it is assigned) its nearest left neighbour. Null and empty
    texts have no candidates; a null path is empty. Three kinds have a part below zero, and their marks stay whole: -1 is
    a value given to a secret word by its name in the token (marks of _NAMED) or by the word before it (any printable
    marks), -2 a password in a URL, -3 a passphrase of PHRASE_WORDS words at most that starts at the token. Repeated
    rows give their candidates again. Very long tokens count whole; extra columns play no part.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), path.alias("path"))
    rows = rows.select("id", "path", F.split("text", "\\s+").alias("words"))

    def token(w: Column, i: Column) -> Column:
        start = F.greatest(F.lit(1), i + 1 - NEIGHBOURS)
        left = F.concat_ws(" ", F.slice("words", start, i + 1 - start))
        right = F.concat_ws(" ", F.slice("words", i + 2, F.lit(NEIGHBOURS)))
        phrase = F.regexp_extract(F.concat_ws(" ", F.slice("words", i + 1, F.lit(PHRASE_WORDS))), _PHRASE, 1)
        return F.struct(
            i.alias("position"), w.alias("word"), left.alias("left"), right.alias("right"), after(i).alias("after"),
            told(i).alias("told"), F.when(phrased(i) & ~phrase.rlike(SENTENCE_WORDS), phrase).alias("phrase"),
        )

    # "=" by itself, or a secret word that ends in it
    before = lambda i: F.get("words", i - 1)
    after = lambda i: F.coalesce(before(i).isin("=", ":", ":=") | (before(i).rlike("[=:]$") & before(i).rlike(SECRET_WORDS)), F.lit(False))
    # "password is x", and "passphrase: w x y z"
    told = lambda i: F.coalesce(before(i).isin(*GIVES) & F.concat_ws(" ", F.get("words", i - 3), F.get("words", i - 2)).rlike(SECRET_WORDS), F.lit(False))
    named = lambda i: before(i).isin(*GIVES, "=", ":", ":=") & F.get("words", i - 2).rlike(PHRASE_NAMES + "$")
    phrased = lambda i: F.coalesce(named(i) | before(i).rlike(PHRASE_NAMES + "(:?=|:)$"), F.lit(False))
    some = lambda w, i: (F.length(w) >= MIN_LENGTH) | ((F.length(w) >= MIN_ASSIGNED) & (w.rlike("[=:]") | after(i) | told(i))) | phrased(i)
    tokens = F.transform("words", lambda w, i: F.when(some(w, i), token(w, i)))
    rows = rows.select("id", "path", F.explode(F.filter(tokens, lambda x: x.isNotNull())).alias("t"))
    rows = rows.select("id", "path", "t.*")
    word, near = F.col("word"), F.col("left").rlike(SECRET_WORDS)
    bare = F.regexp_replace(word, "^[\"'(\\[{<]+|[\"')\\]}>,;.:]+$", "")
    marked = bare.rlike("[^A-Za-z0-9_+/.\\-=]") & bare.rlike("[A-Za-z0-9]") & ~bare.rlike("[\"{}=]|://")
    given = (F.col("told") | (F.col("after") & near)) & marked & (F.length(bare) >= MIN_ASSIGNED)
    name, value = F.regexp_extract(word, _NAMED, 1), F.regexp_extract(word, _NAMED, 2)
    by_name = name.rlike(SECRET_WORDS) & value.rlike(_MARKS) & value.rlike("[A-Za-z0-9]") & (F.length(value) >= MIN_ASSIGNED)
    password = F.regexp_extract(word, _URL_PASSWORD, 2)
    entry = lambda part, v, n: F.struct(F.lit(part).alias("part"), v.alias("value"), n.alias("name"), F.lit("=").alias("sign"))
    rows = rows.withColumn("whole", F.when(by_name, entry(-1, value, name)).when(given, entry(-1, bare, F.lit(""))))
    rows = rows.withColumn("url", F.when(F.length(password) >= MIN_ASSIGNED, entry(-2, password, F.lit("password"))))
    rows = rows.withColumn("phrase", F.when(F.length("phrase") > 0, entry(-3, F.col("phrase"), F.lit(""))))
    # what is taken whole is not cut into pieces as well
    tiled = F.when(F.col("whole").isNotNull(), "").when(F.col("url").isNotNull(), F.regexp_replace(word, _URL_PASSWORD, "$1@")).otherwise(word)
    rows = rows.withColumn("pieces", F.regexp_extract_all(tiled, F.lit(_PIECES), F.lit(0)))

    def piece(v: Column, i: Column) -> Column:
        before = lambda k: F.coalesce(F.get("pieces", i - k), F.lit(""))
        return F.struct(i.alias("part"), v.alias("value"), before(2).alias("name"), before(1).alias("sign"))

    long = lambda v: (F.length(v) >= MIN_ASSIGNED) & v.rlike("^[A-Za-z0-9_+/.\\-]")
    values = F.filter(F.concat(F.transform("pieces", lambda v, i: F.when(long(v), piece(v, i))), F.array("whole", "url", "phrase")), lambda x: x.isNotNull())
    rows = rows.select("id", "path", "position", "left", "right", "after", "told", F.explode(values).alias("v"))
    # name="value", "name":"value" and the like; a value without anything before it is assigned by the word before
    # (a name does not begin with a slash, as a URL's host does)
    assigned = F.col("v.name").rlike("[A-Za-z_.\\-]") & ~F.col("v.name").rlike("^/") & F.col("v.sign").rlike("^[\"']?(:?=|:)[\"']?$")
    alone = (F.col("v.part") == 0) | ((F.col("v.part") == 1) & F.col("v.sign").rlike("^[\"'(\\[{<]+$"))
    found = rows.select(
        "id",
        "position",
        "v.part",
        "path",
        "v.value",
        F.concat_ws(" ", "left", F.nullif("v.name", F.lit(""))).alias("left"),
        "right",
        # a sentence goes on in small letters: "the password is required"
        ((F.col("v.part") < 0) | assigned | (alone & (F.col("after") | (F.col("told") & F.col("v.value").rlike("^.+[^a-z.\\-]"))))).alias("assigned"),
    )
    value, secret = F.col("value"), F.col("left").rlike(SECRET_WORDS)
    usual = (F.length("value") >= MIN_LENGTH) & (value.rlike("[0-9]") | secret | value.rlike(KNOWN_PREFIX))
    # numbers, dates and versions are candidates only as values of a secret word
    return found.where((usual | F.col("assigned")) & (~value.rlike("^[0-9.\\-+/]+$") | (F.col("assigned") & secret)))


def with_features(found: DataFrame) -> DataFrame:
    """found with one double column per feature."""
    v = F.col("value")
    n = F.length(v).cast("double")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    changes = "(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]"
    columns: dict[str, Column] = {
        "length": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "signs": share("[^A-Za-z0-9]"),
        "transitions": share(changes),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "longest_run": F.array_max(F.transform(F.regexp_extract_all(F.concat(v, F.lit(" a")), F.lit("([a-z]+|[A-Z]+|[0-9]+)"), 1), F.length)) / n,
        "covered": 1 - F.length(F.regexp_replace(F.lower(v), DICTIONARY, "")) / n,
        "hex": v.rlike("^[0-9a-fA-F]+$"),
        "known_prefix": v.rlike(KNOWN_PREFIX),
        "near_secret": F.col("left").rlike(SECRET_WORDS),
        "near_other": F.concat_ws(" ", "left", "right").rlike(OTHER_WORDS),
        "assigned": F.col("assigned"),
        "other_path": F.col("path").rlike(OTHER_PATH),
        "words": F.regexp_count(v, F.lit("[^ ]+")),
    }
    return found.select("*", *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"f_{k}") for k, c in columns.items()))


def synthetic_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """Labelled findings made by rules: value, left, right, path, assigned, label (1: a secret).

    Secrets are random keys of usual formats beside telling words; the rest are digests, identifiers, versions, names
    with numbers and placeholders in other surroundings, and some secrets' formats beside words that say otherwise.
    """
    i = F.col("id")
    h = lambda salt: F.sha2(F.concat(i.cast("string"), F.lit(f"/{salt}")), 256)
    pick = lambda salt, *of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(of))) + 1).cast("int"))
    base64 = F.regexp_replace(F.base64(F.unhex(h(1))), "=", "")
    upper = F.translate(F.upper(F.substring(h(2), 1, 16)), "0189", "QZXW")
    words = F.concat_ws("-", pick(3, "release", "build", "customer", "invoice", "document"), pick(4, "number", "version", "page", "item"), F.substring(h(5), 1, 1), i.cast("string"))
    names = F.concat(pick(6, "getUserName", "configValue", "SystemTable", "defaultServer", "user_address_"), F.pmod(i, F.lit(1000)).cast("string"))
    uuid = F.regexp_replace(F.substring(h(7), 1, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    holder = F.concat(pick(8, "your-secret-token-", "example_password_", "changeme-token-", "placeholder-key-"), F.pmod(i, F.lit(100)).cast("string"))
    mail = F.concat(pick(9, "john.smith.", "the.", "anna."), F.pmod(i, F.lit(99)).cast("string"), F.lit(".mail"), F.pmod(i, F.lit(9)).cast("string"), F.lit(".example.com"))
    word = lambda salt: pick(salt, "summer", "dragon", "monkey", "coffee", "winter", "purple", "garden", "silver", "hunter", "rocket", "velvet", "anchor")
    mark = lambda salt: pick(salt, "!", "@", "#", "$", "%", "*", "?")
    number = F.pmod(F.xxhash64(i, F.lit("number")), F.lit(10_000)).cast("string")
    strong = F.concat(F.initcap(word(20)), mark(21), number, mark(22), F.substring(h(23), 1, 3))
    half = F.pmod(F.xxhash64(i, F.lit("half")), F.lit(2)) == 0
    leet = F.concat(F.translate(F.concat(word(24), F.when(half, F.concat(mark(25), word(26))).otherwise(mark(25))), "aeio", "@3!0"), number, F.when(half, "").otherwise(mark(39)))
    phrase = F.concat_ws(" ", *(word(30 + k) for k in range(5)))
    variable = F.concat(pick(40, "$", "%", "#", "**", "$$"), pick(41, "DB_PASSWORD", "SECRET_TOKEN", "API_KEY", "PASSWORD", "USER_SECRET"), pick(42, "", "%", "_FILE", "*"))
    mixed = F.concat(F.substring(h(27), 1, 2), mark(28), F.when(half, F.concat(F.substring(h(48), 1, 1), mark(49))).otherwise(""), F.upper(F.substring(F.translate(h(29), "0123456789", "ghjkmnpqrs"), 1, 1)), mark(37), number, F.substring(F.translate(h(38), "0123456789", "tuvwxyzgjk"), 1, 3))
    kind = F.pmod(F.xxhash64(i, F.lit("kind")), F.lit(20)).cast("int")
    secret_left = pick(10, "the token =", "password:", "api_key =", "with secret", "client secret is", "access key", "aws", "export AUTH", "and of the")
    other_left = pick(11, "commit", "sha256 checksum", "see version", "build", "tracking number", "uuid", "file", "and the", "order id", "of")
    path = pick(12, "src/app.py", "config/prod.yml", "notes", "deploy/env", "web")
    safe_path = pick(13, "tests/data", "docs/readme", "src/app.py", "notes", "package.lock")
    values = [
        (F.substring(h(14), 1, 40), 1), (F.substring(h(15), 1, 18), 1), (base64, 1), (F.concat(F.lit("AKIA"), upper), 1),
        (F.concat(F.lit("ghp_"), F.substring(base64, 1, 36)), 1), (F.concat(F.substring(base64, 5, 20)), 1), (h(16), 1),
        (F.substring(h(17), 1, 40), 0), (h(18), 0), (uuid, 0), (words, 0), (names, 0), (holder, 0), (mail, 0), (strong, 1), (leet, 1), (phrase, 1), (variable, 0), (mixed, 1), (F.concat_ws(" ", *(word(43 + k) for k in range(6))), 1),
    ]
    chosen = F.coalesce(*(F.when(kind == k, F.struct(v.alias("value"), F.lit(y).alias("label"))) for k, (v, y) in enumerate(values)))
    made = spark.range(0, rows, 1, 4).select("id", chosen.alias("x"), secret_left.alias("s"), other_left.alias("o"), path.alias("p"), safe_path.alias("q"))
    good = F.col("x.label") == 1
    # what comes as a candidate only if it is given to a secret word
    given = F.col("x.value").rlike("[!@#$%*? ]")
    return made.select(
        "x.value",
        F.when(given, F.concat(F.col("s"), F.lit(" password"))).when(good | F.col("x.value").rlike("^(your|example|changeme|placeholder)"), F.col("s")).otherwise(F.col("o")).alias("left"),
        F.lit("and then").alias("right"),
        F.when(good, F.col("p")).otherwise(F.col("q")).alias("path"),
        F.when(given, True).when(good, F.pmod(i, F.lit(3)) > 0).otherwise(F.pmod(i, F.lit(4)) == 0).alias("assigned"),
        F.col("x.label").cast("double").alias("label"),
    )


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(with_features(rows))


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate: id, position, part, value, score (0 to 1), predicted (1: a secret).

    A document's repeated tokens give a row each, as do repeated rows; null or empty texts and empty tables give none.
    """
    spark = docs.sparkSession
    known = written(_vectors(synthetic_findings(spark) if findings is None else findings).select("features", "label").coalesce(2))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=32, maxDepth=7, minInstancesPerNode=3, seed=5).fit(known.coalesce(2))
    scored = forest.transform(_vectors(candidates(docs, id_col, text_col, path_col)))
    score = vector_to_array("probability")[1]
    return scored.select("id", "position", "part", "value", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
