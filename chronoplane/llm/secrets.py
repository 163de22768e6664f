"""Secret scans: candidates by pattern, false positives sorted out by a random forest."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplane.llm.common import words

#: A run that can be a key: 16 letters, digits or marks of base64 at least.
CANDIDATE = r"[A-Za-z0-9_+/\-]{16,}={0,2}"
#: Names that call for a secret, with what joins their value to them, up to it.
NAME = r"(?i:passw(?:or)?d|passphrase|pwd|pass|secret|token|api_?key|access_?key|auth|credentials?|key)(?:[_\-][A-Za-z0-9_\-]{0,16}|[A-Z0-9][A-Za-z0-9]{0,16}|s)?[\"'\])]{0,2}"
JOIN = r"(?:[:=]{1,2}|=>)"
#: Stands before a word that is assigned to such a name in the words before.
CALLED = "\x01"
_SET = rf"(?:{NAME}{JOIN}|^{CALLED})"
_KEY_CHAR = r"[A-Za-z0-9_+/\-]"
_PART = r"[A-Za-z0-9_\-]"
#: All that can be a secret inside a word. Values assigned to such a name, in quotes or not, and passwords in URLs may be
#: short and hold any marks. Others are runs: of 16 characters with a letter and a digit (or of a known form), or several
#: of them joined by points, such as web tokens.
SECRET = "|".join(
    [
        rf"(?<=[\"'])(?<={_SET}[\"'])[^\"'{CALLED}]{{4,}}+(?=[\"'])",
        rf"(?<=[:=>{CALLED}(])(?<={_SET}\(?)[^\"'`,;&<>(){{}}\[\]{CALLED}]{{3,}}[^\"'`,;&<>(){{}}\[\]{CALLED}.:?]",
        r"(?<=:)(?<=://[^:/@]{1,64}:)[^/@]{3,}+(?=@)",
        rf"(?<!{_KEY_CHAR})(?:SG\.)?{_PART}{{16,}}+(?:\.{_PART}{{4,}}){{0,7}}\.{_PART}{{16,}}+",
        rf"(?<!{_KEY_CHAR})(?:(?=[A-Za-z_+/\-]*+[0-9])(?=[0-9_+/\-]*+[A-Za-z])|(?=AKIA[A-Z]{{16}}|gh[pousr]_)){_KEY_CHAR}{{16,}}+(?:={{1,2}}(?![=A-Za-z0-9_+/\-]))?",
    ]
)

# Words that speak for or against a secret beside a candidate, and dictionary words inside one.
FOR_WORDS = "password passwd pwd secret token apikey api_key access_key auth credential private bearer key".split()
AGAINST_WORDS = "commit sha sha1 sha256 md5 hash checksum digest integrity uuid guid revision etag build version id example sample dummy".split()
DICTIONARY = """about account after again alpha api application array backup base before between block body browser build
button cache change check child class client close code color column command common config connection content controller
count create current data database date default delete design detail dev device display document domain download edit
element email end error event example export false field file filter final find first folder footer form format from
function general get group handle header height help hidden home host html http icon image import index info input
insert interface item json key label language last layout left level line link list load local log login main manager
map master menu message meta method mode model module month name native new next node normal not number object offset
open option order output page param parent password path placeholder plugin point position post private product
profile project property public query read record redirect ref release remove report request reset resource response
result return root row sample save script search secret section select send server service session set setting show
sign site size source start state status step stop store string style submit success support sync system table target
task team template test text theme time title token tool total track transfer type undefined unit update upload url use
user util value version video view visible web widget width window word work write year your""".split()

FEATURES = ("length", "digits", "uppers", "marks", "turns", "vowel_turns", "repeats", "dictionary", "hex", "uuid", "known", "test_path", "generated_path", "for_word", "against_word", "assigned", "quoted")


def _share(candidate: Column, pattern: str) -> Column:
    return F.regexp_count(candidate, F.lit(pattern)) / F.length(candidate)


def features(found: DataFrame) -> DataFrame:
    """The features of each candidate beside its columns: candidate, prefix, suffix, before, after, path.

    Length; shares of character classes; transitions between classes, and between vowels and consonants; repeated
    characters; share covered by dictionary words; known forms; path; words beside it. Nulls count as empty.
    """
    c, low = F.col("candidate"), F.lower("candidate")
    covered = F.length(c) - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), ""))
    near = F.lower(F.concat_ws(" ", "before", "prefix"))
    word = lambda names: rf"(^|[^a-z]|_)({'|'.join(names)})($|[^a-z0-9])"
    path = F.lower(F.coalesce("path", F.lit("")))
    return found.withColumns(
        {
            "length": F.length(c).cast("double"),
            "digits": _share(c, "[0-9]"),
            "uppers": _share(c, "[A-Z]"),
            "marks": _share(c, "[^A-Za-z0-9]"),
            "turns": _share(c, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
            "vowel_turns": _share(low, "(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])"),
            "repeats": _share(c, r"(.)(?=\1)"),
            "dictionary": covered / F.length(c),
            "hex": c.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
            "uuid": c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$").cast("double"),
            "known": c.rlike("^(AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk_live_[0-9A-Za-z]{24,}|xox[abp]-[0-9A-Za-z-]+|AIza[0-9A-Za-z_-]{35}|glpat-[0-9A-Za-z_-]{20}|eyJ[0-9A-Za-z_-]+\\.eyJ[0-9A-Za-z_-]+\\.[0-9A-Za-z_-]+|SG\\.[0-9A-Za-z_-]+\\.[0-9A-Za-z_-]+)$").cast("double"),
            "test_path": path.rlike("test|example|sample|fixture|mock|docs?/|readme").cast("double"),
            "generated_path": path.rlike(r"\.lock|lock\.json|\.min\.|\.map$|go\.sum|checksums?|vendor/|node_modules").cast("double"),
            "for_word": near.rlike(word(FOR_WORDS)).cast("double"),
            "against_word": F.lower(F.concat_ws(" ", "before", "prefix", "after")).rlike(word(AGAINST_WORDS)).cast("double"),
            "assigned": F.concat_ws(" ", "before", "prefix").rlike("[=:]['\"]?$").cast("double"),
            "quoted": F.coalesce("prefix", F.lit("")).rlike("['\"]$").cast("double"),
        }
    )


def _likely(text: Column) -> Column:
    """Whether a text can hold a candidate."""
    return F.coalesce(text.rlike(CANDIDATE) | text.rlike(rf"{NAME}\s?{JOIN}") | text.rlike(r"://[^\s:/@]{1,64}:[^\s/@]{3,}+@"), F.lit(False))


def candidates(docs: DataFrame, text_col: str, path_col: str | None) -> DataFrame:
    """A row per candidate beside the columns of docs: at (word number), prefix and suffix (what stands before and after it in its word, to the next candidate), the two words before, one after.

    A word gives all its candidates. Before the first one stand the words before, after the last one the word after; others
    have neither. A candidate that is assigned to the one before it has that one in its prefix, as its name.
    """
    likely = docs.where(_likely(F.col(text_col))).withColumn("_words", words(F.col(text_col)))
    get = lambda i: F.coalesce(F.get("_words", i), F.lit(""))
    called = lambda i: get(i - 1).rlike(r"[:=]>?$") & F.concat_ws(" ", get(i - 2), get(i - 1)).rlike(rf"{NAME} ?{JOIN}$")
    scanned = lambda i: F.concat(F.when(called(i), CALLED).otherwise(""), get(i))
    possible = lambda i: (F.length(get(i)) >= 16) | get(i).rlike("[:=]") | called(i)
    at = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: possible(i) & scanned(i).rlike(SECRET))
    rows = likely.withColumn("at", F.explode(at))
    here = F.col("at")
    rows = rows.withColumns({"_word": scanned(here), "_before": F.trim(F.concat_ws(" ", get(here - 2), get(here - 1))), "_after": get(here + 1)}).drop("_words")
    # Gaps and candidates take turns in a word, from a gap to a gap.
    rows = rows.withColumns({"_gaps": F.split("_word", SECRET, -1), "_found": F.regexp_extract_all("_word", F.lit(SECRET), F.lit(0))})

    def found(c: Column, k: Column) -> Column:
        gap, last = F.get("_gaps", k), F.coalesce(F.get("_found", k - 1), F.lit(""))
        named = F.concat(F.right(last, F.lit(1)), gap).rlike(r"^.[\"')\]]{0,2}[:=]|^=[\"']?$")
        prefix = F.when(k == 0, F.regexp_replace(gap, f"^{CALLED}", "")).when(named, F.concat(last, gap)).otherwise(gap)
        before, after = F.when(k == 0, F.col("_before")).otherwise(""), F.when(k == F.size("_found") - 1, F.col("_after")).otherwise("")
        return F.struct(prefix.alias("prefix"), c.alias("candidate"), F.get("_gaps", k + 1).alias("suffix"), before.alias("before"), after.alias("after"))

    rows = rows.select(*docs.columns, "at", F.inline(F.transform("_found", found)))
    return rows.withColumn("path", F.col(path_col).cast("string") if path_col else F.lit(""))


def labelled_findings(spark: SparkSession, count: int = 12_000, seed: int = 7) -> DataFrame:
    """`count` labelled findings to train on: candidate, prefix, suffix, before, after, path, label.

    Drawn from forms that are secrets (keys of known services, random strings assigned to a name that calls for one) and
    from forms that are taken for them (digests, commit ids, UUIDs, placeholders, names, paths, long words with a number).
    """
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    r = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 30))
    one = lambda k, options: F.element_at(F.array(*map(F.lit, options)), (r(k) % len(options) + 1).cast("int"))

    def draw(k: int, size: Column, low: int = 0, high: int = len(chars)) -> Column:
        alphabet = chars[low:high]
        return F.array_join(F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(F.lit(alphabet), (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id", i), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))), "")

    hex_of = lambda k, n: F.substring(F.sha2(F.concat(F.lit(f"{seed}.{k}."), F.col("id").cast("string")), 512), 1, n)
    size = (16 + r(1) % 32).cast("int")
    digest = F.concat_ws("-", hex_of(3, 8), F.substring(hex_of(4, 4), 1, 4), hex_of(5, 4), hex_of(6, 4), hex_of(7, 12))
    filler = ["", "the of", "and in", "with a", "is to", "value for", "return new", "see also"]
    keyword = [f"{w} {o}" for w in ("password", "token", "secret", "api_key", "auth_token") for o in ("=", ":")] + ["password=", "token=", "secret:", "key="]
    name = F.concat(*[F.initcap(one(20 + i, DICTIONARY)) for i in range(4)], (r(24) % 100).cast("string"))
    kinds = [  # label, candidate, before, prefix, path
        (1, F.concat(F.lit("AKIA"), draw(30, F.lit(16), 0, 26)), one(31, filler), F.lit(""), ""),
        (1, F.concat(F.lit("AKIA"), F.upper(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 15)), F.lit("Q")), one(31, filler + keyword), F.lit(""), ""),
        (1, F.concat(F.lit("ghp_"), draw(32, F.lit(36))), one(33, filler + keyword), F.lit(""), "src/app.py"),
        (1, hex_of(34, 40), one(35, keyword[:10]), F.lit('"'), ""),
        (1, F.substring(hex_of(36, 64), F.lit(1), F.greatest(size, F.lit(16))), one(37, filler), one(38, ["password=", "token=", "secret=", "api_key=", "passwd:"]), ""),
        (1, draw(39, size), one(40, keyword), one(41, ["", '"', "'"]), "config/settings.py"),
        (1, draw(42, size), one(43, filler), one(44, ["password=", "token=", 'secret="', "key="]), ".env"),
        (1, F.concat(draw(45, F.lit(40)), F.lit("=")), one(46, ["secret =", "access_key :", "credential ="]), F.lit('"'), "deploy/values.yml"),
        (0, hex_of(47, 40), one(48, ["commit", "revision", "in commit", "sha1 of", "etag :", "build"]), F.lit(""), "CHANGELOG"),
        (0, hex_of(49, 64), one(50, ["sha256 :", "checksum =", "digest", "integrity :", "hash =", "md5 is"]), one(51, ["", '"', "sha256-", "sha256:"]), "package-lock.json"),
        (0, hex_of(52, 32), one(53, filler + ["md5 =", "etag"]), F.lit(""), "dist/app.min.js"),
        (0, digest, one(54, filler + ["id =", "uuid :", "guid"]), one(55, ["", '"']), ""),
        (0, F.concat(F.lit("your_"), one(56, DICTIONARY), F.lit("_"), one(57, DICTIONARY), F.lit("_here1")), one(58, keyword), one(59, ["", '"']), "README.md"),
        (0, F.concat(F.lit("EXAMPLE"), F.repeat(F.lit("x"), 14), F.lit("1")), one(60, keyword), F.lit('"'), "docs/example.md"),
        (0, F.repeat(one(61, ["0", "1", "a1", "12", "x9"]), 20), one(62, keyword + filler), F.lit(""), "tests/fixtures/data"),
        (0, name, one(63, filler + keyword), F.lit(""), "src/app.py"),
        (0, F.concat_ws("/", one(64, DICTIONARY), one(65, DICTIONARY), one(66, DICTIONARY), F.concat(one(67, DICTIONARY), (r(68) % 1000).cast("string"))), one(69, filler), F.lit(""), ""),
        (0, F.concat(one(70, DICTIONARY), F.lit("-"), one(71, DICTIONARY), F.lit("-"), one(72, DICTIONARY), F.lit("-"), (2000 + r(73) % 30).cast("string")), one(74, filler), one(75, ["", "id=", "version=", "href="]), ""),
        (0, F.concat(one(76, ["the", "tion", "chen", "mente"]), one(77, DICTIONARY), one(78, ["ation", "heit", "ement", "ción"]).substr(1, 4), one(79, DICTIONARY), (r(80) % 10).cast("string")), one(81, filler), F.lit(""), ""),
    ]
    mark = lambda k: one(k, list("!@#$%*?-_."))
    field = lambda k, names: F.concat(one(k, ['","', ',"', '{"', "?", "&"]), one(k + 1, names), one(k + 2, ['":"', "=", ":"]))
    calling = ["password", "token", "secret", "api_key", "key", "access_key"]
    kinds += [  # values inside a word, tokens of several parts, short and marked values
        (1, F.concat(F.lit("eyJ"), draw(200, F.lit(17)), F.lit(".eyJ"), draw(201, size), F.lit("."), draw(202, F.lit(43))), one(203, filler + keyword + ["Authorization: Bearer"]), one(204, ["", '"', "token=", '","jwt":"']), ""),
        (1, draw(205, F.lit(40)), one(206, filler), field(207, ["s", "k", "sk", "value"] + calling), ""),
        (1, F.concat(F.lit("ghp_"), draw(210, F.lit(36))), one(211, filler), field(212, ["v", "access", "auth"] + calling), ""),
        (1, draw(215, (8 + r(216) % 8).cast("int")), one(217, keyword), one(218, ["", '"', "'"]), ""),
        (1, F.concat(draw(219, (3 + r(220) % 4).cast("int")), mark(221), draw(222, (3 + r(223) % 6).cast("int")), mark(224)), one(225, keyword), one(226, ["", '"', "'"]), ""),
        (1, F.concat(F.initcap(one(227, DICTIONARY)), (r(228) % 9000 + 1000).cast("string"), mark(229)), one(230, filler), one(231, ["password=", 'password":"', "pwd:", "passwd=", 'secret="']), ""),
        (1, F.concat(draw(232, (3 + r(233) % 4).cast("int")), mark(234), draw(235, (3 + r(236) % 6).cast("int"))), one(237, filler), one(238, ["postgres://app:", "mysql://root:", "https://user:", "amqp://svc:"]), ""),
        (0, one(239, DICTIONARY), one(240, keyword), one(241, ["", '"', "'"]), ""),
        (0, F.concat(one(242, DICTIONARY), one(243, ["_", "-", "."]), one(244, DICTIONARY)), one(245, keyword), one(246, ["", '"']), ""),
        (0, F.concat(one(247, ["process.env.", "self.", "os.environ.", "config."]), one(248, DICTIONARY)), one(249, keyword), F.lit(""), ""),
        (0, F.repeat(one(250, ["*", "x", "X", ".", "-", "0"]), 9), one(251, keyword), one(252, ["", '"']), ""),
        (0, one(253, ["changeme", "required", "optional", "string", "undefined", "None,", "your_password", "placeholder"]), one(254, keyword), one(255, ["", '"']), ""),
        (0, F.concat(one(256, DICTIONARY), F.lit("-"), (2000 + r(257) % 30).cast("string"), F.lit("-"), one(258, DICTIONARY), F.lit("-"), (r(259) % 10).cast("string")), one(260, filler), field(261, ["id", "version", "name", "sha", "slug"]), ""),
        (0, F.concat(F.lit("com/"), one(264, DICTIONARY), F.lit("/"), (2000 + r(265) % 30).cast("string"), F.lit("/"), one(266, DICTIONARY)), one(267, filler), one(268, ["https://host.example.", "http://www.", '","url":"https://']), ""),
        (0, F.concat(*[x for i in range(3) for x in (one(270 + 3 * i, DICTIONARY), F.initcap(one(271 + 3 * i, DICTIONARY)), F.lit("Impl" + "." * (i < 2)))], (r(280) % 10).cast("string")), one(281, filler), F.lit(""), "src/app.py"),
        (0, hex_of(282, 40), one(283, filler), field(284, ["sha", "commit", "etag", "digest", "hash"]), ""),
    ]
    kind = r(0) % len(kinds)
    pick = lambda i: F.coalesce(*[F.when(kind == k, (F.lit(row[i]) if not isinstance(row[i], Column) else row[i])) for k, row in enumerate(kinds)])
    rows = spark.range(count).select("id", pick(1).alias("candidate"), pick(2).alias("before"), pick(3).alias("prefix"), pick(4).alias("path"), pick(0).cast("double").alias("label"))
    return rows.select("candidate", "prefix", F.when(F.col("prefix").endswith('"'), '"').otherwise("").alias("suffix"), "before", one(90, filler).alias("after"), "path", "label")


def train(labelled: DataFrame, trees: int = 30, depth: int = 8, seed: int = 7, most: int = 50_000) -> PipelineModel:
    """A random forest over labelled findings. `most` bounds the rows it is fitted to: of more, an even share is drawn."""
    n = labelled.count()
    if not n:
        raise ValueError("there are no labelled findings to train on")
    kept = labelled if n <= most else labelled.sample(most / n, seed)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features", subsamplingRate=0.8, featureSubsetStrategy="sqrt")
    fitted: RandomForestClassificationModel = forest.fit(assembler.transform(features(kept)))
    return PipelineModel([assembler, fitted])


def score(found: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds `score`, the forest's probability that a candidate is a secret."""
    own = ["features", "rawPrediction", "probability", "prediction"]
    scored = model.transform(features(found)).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    return scored.drop(*own, *FEATURES)


def scan_secrets(docs: DataFrame, model: PipelineModel, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """All candidates of all texts with the forest's verdict: doc_id, at, candidate_sha256, length, before, score, is_secret.

    A candidate's text isn't returned, only its digest. DataFrame functions only. Null, empty and short texts have no
    candidates; null ids, paths and neighbours are kept as they are. Equal rows give equal findings, each its own. No
    rows give no rows. Other columns aren't read.
    """
    cols = [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.col(path_col) if path_col else F.lit("")).cast("string").alias("path")]
    found = score(candidates(docs.select(*cols), "text", "path").drop("text"), model)
    return found.select("doc_id", F.col("at").cast("long").alias("at"), F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").cast("long").alias("length"), F.lower("before").alias("before"), "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, model: PipelineModel, *, text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced by a mark; all rows are kept, clean texts untouched.

    A secret goes wherever it stands in its text, one of fewer than 16 characters only where no letter, digit or
    underscore is beside it. Only rows that can have candidates are shuffled. They are keyed by a hash of the whole row:
    equal rows have equal secrets.
    """
    row = F.struct(*[docs[c] for c in docs.columns])
    base = docs.select(row.alias("row"), docs[text_col].cast("string").alias("text"), (docs[path_col] if path_col else F.lit("")).cast("string").alias("path"))
    likely = _likely(F.col("text"))
    suspect = base.where(likely).withColumn("key", F.xxhash64("row"))
    found = score(candidates(suspect.select("key", "text", "path"), "text", "path").drop("text"), model).where(F.col("score") >= threshold)
    secrets = found.groupBy("key").agg(F.array_sort(F.collect_set("candidate"), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)).alias("secrets"))
    joined = suspect.join(secrets, "key", "left")
    apart = lambda s: F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![A-Za-z0-9_])"))
    quoted_mark = mark.replace("\\", "\\\\").replace("$", "\\$")
    without = lambda t, s: F.when(F.length(s) >= 16, F.replace(t, s, F.lit(mark))).otherwise(F.regexp_replace(t, apart(s), F.lit(quoted_mark)))
    cleaned = F.when(F.col("secrets").isNull(), F.col("text")).otherwise(F.aggregate("secrets", F.col("text"), without))
    columns = [cleaned.cast(docs.schema[text_col].dataType).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return joined.select(*columns).union(base.where(~likely).select("row.*"))
