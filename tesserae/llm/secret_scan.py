"""Secret scans with a random forest that removes false positives.

Candidates lie inside words, wherever quotes, commas, braces, `?` or `&` put them:

* a value of FEW characters or more, of any kind, under a key that names a secret: `password=...`,
  `{"api_key":"..."}`, `?token=...`, or with the key and its sign in the words before;
* a run of MANY characters or more of `[A-Za-z0-9_+/=~.-]`, with its key if it has one;
* the password of an address (`scheme://user:password@host`);
* a private key's block, from its BEGIN line to its END line.

A forest judges each by its length, the mean log-probability of its character
transitions and the share of changes between classes of characters, the share that a
dictionary covers, its key path, the document's path, and the neighbouring words. The
dictionary is WORDS_KEPT words, those that occur most in all documents scanned, with
some of code and of prose; it is held as a bit set of fixed size (a word that is not in it
passes for one of it in 1 of 200 cases). The forest is trained from labelled findings, at
most FINDINGS of them, once in a session's driver; it and the bit set are one row each,
which is broadcast, so a scan has no Python and shuffles no text.

Null and empty texts have no candidates, a word of any length is scanned whole and in
linear time; a secret that occurs twice is found twice; rows under one doc_id are scanned
each, equal rows give equal findings; of words that occur equally often the lesser is kept.
Empty tables give no findings. scan() leaves further columns out, redact() passes the
input's columns on, whatever their names.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import checkpointed, documents, text_key, with_row, words
from tesserae.llm.quality_rules import let

#: Labelled findings that a forest is fitted on at most, and words that a dictionary holds of a corpus.
FINDINGS, WORDS_KEPT = 8000, 20_000
TREES, DEPTH = 24, 7
#: Share of trees that must be passed for a candidate to be a secret.
THRESHOLD = 0.5
#: Characters of a value with a secret's key, and of one without.
FEW, MANY = 4, 16
#: Bits of a dictionary; each word sets two.
BITS = 1 << 19

SECRET = r"pass(?:word|wd|phrase)?|pwd|secret|token|credential|auth|api[_\-]?key|access[_\-]?key|private|bearer|login"
HARMLESS = r"commit|revision|sha|md5|checksum|digest|hash|uuid|guid|version|build|file|path|url|page|class|method|figure|image|isbn|serial|order|invoice"
EXAMPLE = r"example|sample|test|dummy|fake|placeholder|your|changeme|xxxx|todo|demo|none|null|<|\$\{"
PREFIXES = r"^(?:AKIA|ASIA|gh[pousr]_|sk_(?:live|test)_|xox[baprs]-|AIza|eyJ|glpat-|-----BEGIN)"

NAME, PLAIN = r"[A-Za-z0-9_.\-]", r"[A-Za-z0-9_+/=~.\-]"
KEY = rf"(?<!{NAME})[A-Za-z_]{NAME}{{0,60}}+[\"'\])]{{0,2}}+(?:=>|:=|[:=])(?!//)(?![A-Za-z][A-Za-z0-9+.\-]{{0,10}}+://)"
FREE = rf"(?:[^\"'`,;&<>()\[\]{{}}]|&(?!{NAME}{{1,60}}+=))"
SECRET_PAIR = rf"(?<!{NAME})(?=(?:{NAME}{{0,60}}?)(?i:{SECRET})){KEY}(?:\"[^\"]{{{FEW},}}+\"?|'[^']{{{FEW},}}+'?|{FREE}{{{FEW},}}+)"
OTHER_PAIR = rf"{KEY}[\"'(\[<]{{0,2}}+{PLAIN}{{{MANY},}}+"
ADDRESS = r"://[^/@:\"']{0,100}+:[^/@\"']++@"
RUN = rf"(?<!{PLAIN}){PLAIN}{{{MANY},}}+"
#: What may be a candidate in a word.
PIECE = f"{ADDRESS}|{SECRET_PAIR}|{OTHER_PAIR}|{RUN}"
PEM = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----(?:[^\-]|-(?!----))*+(?:-----END [A-Z0-9 ]{0,40}-----)?"
SIGN = r"(?:=>|:=|[:=])$"

#: Ordinary words of code and of prose, for transitions, and for dictionaries without a corpus.
BASE = (
    "the and for that with this from have are not was but you all can her his they one had word what were when your said there use each which their will other about many then them "
    "these some would make like into time has look two more write see number way could people than first water been call who oil its now find long down day did get come made may part over "
    "new sound take only little work know place year live back give most very after thing our just name good sentence man think say great where help through much before line right too mean old "
    "any same tell boy follow came want show also around form three small set put end does another well large must big even such because turn here why ask went men read need land different home "
    "move try kind hand picture again change off play spell air away animal house point page letter mother answer found study still learn should world high every near add food between own below "
    "country plant last school father keep tree never start city earth eye light thought head under story left few while along might close something seem next hard open example begin life always "
    "those both paper together got group often run important until children side feet car mile night walk white sea began grow took river four carry state once book hear stop without second later "
    "user index data base code file test list type view link html image config string number object value class method function return request response message server client service handler "
    "manager factory builder reader writer parser buffer stream socket thread process memory cache queue stack table column record field schema query result error warning exception build version "
    "release package module import export public static final void main abstract interface extends implements override default system logger format update delete insert select create remove "
    "password token secret access login account email address phone order invoice customer product price item total count size length width height color style script document window event target "
    "key path root node graph edge point vector matrix color session context filter transform window parameter argument variable constant template example sample production development environment "
    "international communication responsibility administration environmental representative characteristics understanding electronic transportation organization institution information government "
    "que les des elle est une dans pour pas sur plus avec sont par nous vous être fait comme tout bien sans aussi leur deux même los del las una por con para como más pero sus este entre cuando "
    "muy sin sobre también hasta hay donde der die und den von das mit sich des auf für ist nicht ein eine als auch werden aus hat dass sie nach wird bei einer um am sind noch wie einem über so zum"
).split()
ALPHABET = "abcdefghijklmnopqrstuvwxyz9~-"
FEATURES = (
    "length", "transitions", "changes", "digits", "capitals", "signs", "spread", "coverage", "prefix", "example", "kind",
    "has_path", "path_secret", "path_harmless", "doc_example", "near_secret", "near_harmless", "near_equals",
)


def key_of(word: Column) -> Column:
    """The name that a word ends with, before its sign; empty if there is none."""
    return F.regexp_extract(word, rf"(?<!{NAME})([A-Za-z_]{NAME}{{0,60}}+)[\"'\])]{{0,2}}+(?:=>|:=|[:=])?$", 1)


def pieces(rows: DataFrame, *keep: str) -> DataFrame:
    """path, value, kind (1 in an address or a block) of the candidates in column word, by the columns before1 and before2."""
    no = F.lit("")
    before1, before2, word = F.coalesce("before1", no), F.coalesce("before2", no), F.col("word")
    key = F.when(before1.rlike(f"^{SIGN}"), key_of(before2)).when(before1.rlike(SIGN), key_of(before1)).otherwise(no)
    block = word.startswith("-----BEGIN ") & word.contains("PRIVATE KEY-----")
    # A quoted value ends with its quote, another one before closing marks.
    whole = F.when(word.rlike(r"^[\"'`]"), F.regexp_extract(word, r"^[\"'`]([^\"'`]*+)", 1)).otherwise(F.regexp_replace(F.regexp_replace(word, r"^[(\[<{]++", ""), r"[.,;:!?)\]>}](?![^.,;:!?)\]>}])[.,;:!?)\]>}]*+$", ""))
    alone = key.rlike(f"(?i:{SECRET})") & (F.length(whole) >= FEW) & ~word.rlike(f"^[\"'(\\[{{]{{0,3}}+(?:{SECRET_PAIR}|{OTHER_PAIR})") & ~word.contains("://")
    found = F.when(block, F.array(word)).when(alone, F.array(whole)).otherwise(F.regexp_extract_all("word", F.lit(PIECE), F.lit(0)))
    rows = rows.select("*", key.alias("key"), block.alias("block"), (~block & alone).alias("alone"), F.posexplode(found).alias("piece_no", "piece"))
    piece = F.col("piece")
    pair = ~F.col("alone") & piece.rlike(f"^(?:{SECRET_PAIR}|{OTHER_PAIR})")
    address = ~F.col("alone") & piece.startswith("://") & piece.endswith("@")
    after_key = F.regexp_replace(piece, rf"^{KEY}[\"'(\[<]{{0,2}}+", "")
    # At most a few closing marks, cut off from the end.
    trimmed = F.regexp_replace(after_key, r"(?<![\"'.,:;])[\"'.,:;]++$", "")
    value = F.when(F.col("block") | F.col("alone"), piece).when(address, F.regexp_extract(piece, r"^://[^:]*+:(.*)@$", 1)).when(pair, trimmed).otherwise(F.regexp_replace(piece, r"(?<!\.)\.++$", ""))
    path = F.when(pair, F.regexp_extract(piece, rf"^([A-Za-z_]{NAME}{{0,60}}+)", 1)).when(F.col("block") | address, no).otherwise(F.col("key"))
    rows = rows.select(*keep, "piece_no", path.alias("path"), value.alias("value"), F.when(F.col("block") | address, 1.0).otherwise(0.0).alias("kind"), "before1", "before2", "before3", "after")
    return rows.where(F.length("value") >= F.when(F.col("path").rlike(f"(?i:{SECRET})") | (F.col("kind") > 0), FEW).otherwise(MANY))


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """doc_id, tk, doc_path, word_no, and the columns of pieces()."""
    w, text = F.col("w"), F.coalesce(F.col(text_col), F.lit(""))
    marked = lambda x: x.contains("=") | x.contains(":")
    maybe = lambda i: (F.length(F.get(w, i)) >= FEW) & ((F.length(F.get(w, i)) >= MANY) | marked(F.get(w, i)) | F.coalesce(F.right(F.get(w, i - 1), F.lit(1)).isin("=", ":", ">"), F.lit(False)))
    at = F.filter(F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)), maybe)
    around = lambda i, word: F.struct(i.cast("long").alias("word_no"), word.alias("word"), *(F.get(w, i - k).alias(f"before{k}") for k in (1, 2, 3)), F.get(w, i + 1).alias("after"))
    blocks = F.when(text.contains("-----BEGIN "), F.regexp_extract_all(text, F.lit(PEM), F.lit(0)))
    thin = docs.select(
        F.col(id_col).alias("doc_id"),
        text_key(F.col(text_col)).alias("tk"),
        (F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")).alias("doc_path"),
        words(text).alias("w"),
        F.transform(F.coalesce(blocks, F.array().cast("array<string>")), lambda b: F.struct(F.size(words(F.call_function("substring_index", text, b, F.lit(1)))).alias("i"), b.alias("b"))).alias("blocks"),
    )
    found = F.concat(F.coalesce(F.transform(at, lambda i: around(i, F.get(w, i))), F.array()), F.transform("blocks", lambda b: around(b["i"], b["b"])))
    each = thin.select("doc_id", "tk", "doc_path", F.explode(found).alias("c")).select("doc_id", "tk", "doc_path", "c.*")
    return pieces(each, "doc_id", "tk", "doc_path", "word_no")


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def bit_places(word: Column) -> Column:
    return F.array(*(F.pmod(F.xxhash64(F.lit(salt), word), F.lit(BITS)) for salt in (1, 2)))


def dictionary(held: DataFrame) -> DataFrame:
    """One row: bits, a set of the words (column word) as an array of BITS / 64 numbers."""
    places = held.select(F.explode(bit_places(F.col("word"))).alias("at"))
    slots = places.groupBy(F.floor(F.col("at") / 64).alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("b"))
    full = held.sparkSession.range(BITS // 64).select(F.col("id").alias("slot")).join(slots, "slot", "left")
    return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", F.coalesce("b", F.lit(0)).alias("b")))), lambda x: x["b"]).alias("bits"))  # a fixed number


def base_words(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT explode(split(:w, ' ')) AS word", args={"w": " ".join(BASE)})


def corpus_words(docs: DataFrame, text_col: str) -> DataFrame:
    """The WORDS_KEPT words of three letters or more that occur most, and BASE."""
    each = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("word"))
    most = each.groupBy("word").count().orderBy(F.desc("count"), "word").limit(WORDS_KEPT).select("word")
    return most.unionByName(base_words(docs.sparkSession))


@lru_cache(maxsize=1)
def transition_table() -> list[float]:
    """Log-probability of each character class after each other one, over BASE with each pair counted once more."""
    n = len(ALPHABET)
    pairs = [[1.0] * n for _ in range(n)]
    for word in BASE:
        s = re.sub(r"[^a-z]", "~", word.lower())
        for a, b in zip(s, s[1:]):
            pairs[ALPHABET.index(a)][ALPHABET.index(b)] += 1
    return [math.log(x / sum(row)) for row in pairs for x in row]


def with_features(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Adds x, an array of doubles, one for each of FEATURES. bits: see dictionary()."""
    v, n, path = F.col("value"), F.length("value").cast("double"), F.coalesce("path", F.lit(""))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[^A-Za-z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")
    count = lambda c: F.length("_kinds").cast("double") - F.length(F.replace(F.col("_kinds"), F.lit(c)))
    symbols = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(v), "[0-9]", "9"), r"[\p{L}&&[^a-z]]", "~"), "[^a-z9~]", "-")
    near = F.concat_ws(" ", "before3", "before2", "before1", "after")
    columns = {
        "_kinds": kinds,
        "_places": F.transform(F.split(symbols, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1),
        "_subwords": F.filter(F.transform(F.regexp_extract_all(v, F.lit(r"\p{Lu}?\p{Ll}{2,}+|\p{Lu}{3,}+"), F.lit(0)), lambda s: F.lower(s)), lambda s: F.length(s) >= 3),
    }
    rows = rows.withColumns(columns)
    table = rows.sparkSession.sql("SELECT from_json(t, 'array<double>') AS _table FROM VALUES (:t) AS v(t)", args={"t": json.dumps(transition_table())})
    rows = rows.crossJoin(F.broadcast(bits.select(F.col("bits").alias("_bits")))).crossJoin(F.broadcast(table))  # one row each
    places, size = F.col("_places"), len(ALPHABET)
    steps = F.transform(F.slice(places, 1, F.size(places) - 1), lambda a, i: F.get("_table", a * size + F.get(places, i + 1)))
    held = lambda s: F.forall(bit_places(s), lambda p: F.getbit(F.get("_bits", F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)
    known = F.aggregate(F.filter("_subwords", held), F.lit(0), lambda a, s: a + F.length(s))
    x = {
        "length": F.least(n, F.lit(1000.0)),
        "transitions": F.when(F.size(places) > 1, F.aggregate(steps, F.lit(0.0), lambda a, s: a + s) / (F.size(places) - 1)).otherwise(F.lit(0.0)),
        "changes": (F.length(F.regexp_replace("_kinds", r"(.)\1++", "$1")).cast("double") - 1) / n,
        "digits": count("9") / n,
        "capitals": count("A") / n,
        "signs": count("-") / n,
        "spread": F.size(F.array_distinct(F.split(v, ""))).cast("double") / n,
        "coverage": known.cast("double") / n,
        "prefix": flag(v.rlike(PREFIXES)),
        "example": flag(v.rlike(f"(?i:{EXAMPLE})")),
        "kind": F.col("kind"),
        "has_path": flag(path != ""),
        "path_secret": flag(path.rlike(f"(?i:{SECRET})")),
        "path_harmless": flag(path.rlike(f"(?i:{HARMLESS})")),
        "doc_example": flag(F.col("doc_path").rlike(f"(?i:{EXAMPLE})")),
        "near_secret": flag(near.rlike(f"(?i:{SECRET})")),
        "near_harmless": flag(near.rlike(f"(?i:{HARMLESS})")),
        "near_equals": flag(F.col("before1").rlike(SIGN)),
    }
    return rows.withColumn("x", F.array(*(x[k] for k in FEATURES))).drop("_kinds", "_places", "_subwords", "_bits", "_table")


def labelled_findings(spark: SparkSession, n: int = FINDINGS, seed: int = 5) -> DataFrame:
    """Labelled findings, made: half are secrets of common kinds, half are what scanners mistake for secrets. Columns: label, those of pieces(), doc_path."""
    rnd = lambda k: F.sha2(F.concat_ws("|", F.lit(seed), F.lit(k), F.col("id")), 256)
    number = lambda k, m: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), F.lit(m)).cast("int")
    pick = lambda k, xs: F.get(F.array(*map(F.lit, xs)), number(k, len(xs)))
    upto = lambda text, k, least, more: F.substr(text, F.lit(1), F.lit(least) + number(k, more))
    mixed = F.translate(F.base64(F.unhex(rnd("b"))), "+/=", "xYz")
    signed = F.concat(F.translate(F.base64(F.unhex(rnd("s"))), "+/=ABCD", "$!@#%^&"))
    code = [w for w in BASE if len(w) > 3 and w.isascii()]
    a, b, c = pick("w1", code), pick("w2", code), pick("w3", code)
    plain = pick("p", ["", "", "", "the", "of", "and", "with", "le", "de", "und", "return", "see"])
    secret_word = pick("q", ["password", "token", "secret", "api_key", "auth_token", "db.password", "access_key", "passwd", "client_secret", "TOKEN", "PASSWORD", "pwd", "privateKey"])
    harmless_word = pick("h", ["commit", "sha", "checksum", "revision", "uuid", "build", "file", "url", "md5", "etag", "hash", "digest"])
    hex_ = F.when(number("hu", 4) == 0, F.upper(rnd("x"))).otherwise(rnd("x"))
    hex_ = upto(hex_, "l", 16, 26)
    equals = pick("eq", ["=", ":", ":=", "="])
    human = F.concat(F.initcap(a), number("d1", 1000).cast("string"), pick("sg", ["!", "$", "#", "&", "%", "", "@"]), upto(b, "hb", 2, 3))
    leet = F.concat(F.translate(a, "aeios", "43105"), pick("sg2", ["!", "$", "", "#"]), number("d2", 100).cast("string"))
    no = F.lit("")
    # label, path, value, kind, word before, the one before that
    kinds = [
        (1, no, F.concat(F.lit("AKIA"), F.substring(F.upper(mixed), 1, 16)), 0, plain, plain),
        (1, secret_word, hex_, 0, plain, plain),
        (1, secret_word, hex_, 0, equals, secret_word),
        (1, no, F.concat(pick("g", ["ghp_", "gho_", "sk_live_", "xoxb-", "glpat-", "AIza", "eyJ"]), F.substring(mixed, 1, 32)), 0, plain, plain),
        (1, secret_word, upto(mixed, "m1", 8, 24), 0, plain, plain),
        (1, secret_word, upto(mixed, "m2", 20, 24), 0, equals, secret_word),
        (1, secret_word, upto(signed, "m3", 8, 16), 0, plain, plain),
        (1, secret_word, human, 0, plain, plain),
        (1, secret_word, leet, 0, equals, secret_word),
        (1, no, F.when(number("ad", 2) == 0, human).otherwise(upto(mixed, "m4", 8, 16)), 1, plain, plain),
        (1, no, F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), mixed, mixed, F.lit("\n-----END RSA PRIVATE KEY-----")), 1, plain, plain),
        (0, no, F.concat(a, b, c, pick("w4", code)), 0, plain, plain),
        (0, no, hex_, 0, plain, harmless_word),
        (0, harmless_word, hex_, 0, plain, plain),
        (0, harmless_word, hex_, 0, equals, harmless_word),
        (0, no, F.concat_ws("-", *(F.substring(rnd("u"), p, q) for p, q in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), 0, plain, plain),
        (0, secret_word, pick("e", ["your_password_here", "example_password", "changeme_changeme", "xxxxxxxxxxxxxxxxxxxx", "sample-token-value", "placeholder.token", "test_secret_value_1", "None", "null", "<token>", "${TOKEN}", "********"]), 0, plain, plain),
        (0, secret_word, F.when(number("sp", 2) == 0, F.call_function("concat_ws", pick("js", ["_", ".", "-"]), a, b)).otherwise(a), 0, plain, plain),
        (0, secret_word, F.when(number("sq", 2) == 0, a).otherwise(F.concat(a, F.lit("."))), 0, equals, secret_word),
        (0, no, F.concat(a, F.initcap(b), F.initcap(c), F.initcap(pick("w5", code))), 0, plain, plain),
        (0, no, F.call_function("concat_ws", pick("jn", ["/", ".", "_", "-"]), a, b, c, pick("w6", code)), 0, plain, plain),
        (0, harmless_word, F.concat_ws("/", a, b, F.concat(c, pick("ex", [".html", ".py", ".txt", ".json"]))), 0, plain, plain),
        (0, no, pick("i", ["================", "------------------------", "2024-01-01T12:30:00", "20240101123000123", "0000000000000000", "....................", "________________"]), 0, plain, plain),
        (0, no, F.lpad(F.translate(rnd("n"), "abcdef", "012345"), 16, "4"), 0, plain, plain),
    ]
    structs = [
        F.struct(F.lit(label).alias("label"), path.alias("path"), value.alias("value"), F.lit(float(kind)).alias("kind"), one.alias("before1"), other.alias("before2"))
        for label, path, value, kind, one, other in kinds
    ]
    rows = spark.range(n).select(F.get(F.array(*structs), F.pmod("id", F.lit(len(kinds))).cast("int")).alias("f")).select("f.*")
    return rows.select("*", F.lit("").alias("before3"), F.lit("").alias("after"), F.lit("").alias("doc_path"))


#: A forest as arrays over its nodes; a leaf leads to itself. roots: the node that each tree begins with.
Forest = dict[str, list]
MODEL = "roots array<int>, feature array<int>, threshold array<double>, low array<int>, high array<int>, vote array<double>, steps array<int>"


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> Forest:
    """A forest. findings: label (0, 1), doc_path and the columns of pieces(); FINDINGS rows are used at most."""
    rows = with_features(findings.limit(FINDINGS), dictionary(base_words(findings.sparkSession)))
    rows = rows.select(F.col("label").cast("double").alias("label"), *(F.get("x", F.lit(k)).alias(name) for k, name in enumerate(FEATURES)))
    rows = checkpointed(rows)  # the fit reads it several times
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return parse_forest(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(data))


def parse_forest(forest: RandomForestClassificationModel) -> Forest:
    """The forest's printed form as arrays."""
    out: Forest = {k: [] for k in ("roots", "feature", "threshold", "low", "high", "vote")}

    def node(lines: list[str]) -> int:
        line, own = lines.pop(0), len(out["vote"])
        for k, x in zip(("feature", "threshold", "low", "high", "vote"), (0, 0.0, own, own, 0.0)):
            out[k].append(x)
        if m := re.fullmatch(r"Predict: ([0-9.]+)", line):
            out["vote"][own] = float(m[1])
            return own
        m = re.fullmatch(r"If \(feature (\d+) <= ([-0-9.Ee]+)\)", line)
        out["feature"][own], out["threshold"][own] = int(m[1]), float(m[2])
        out["low"][own] = node(lines)
        lines.pop(0)  # Else
        out["high"][own] = node(lines)
        return own

    for block in re.split(r"\n\s+Tree \d+ .*:\n", forest.toDebugString)[1:]:
        out["roots"].append(node([x.strip() for x in block.strip().split("\n")]))
    out["steps"] = list(range(max(t.depth for t in forest.trees)))
    return out


_fitted: dict[tuple, Forest] = {}


def default_forest(spark: SparkSession) -> Forest:
    """The forest of labelled_findings(), which is the same in every session."""
    key = (FINDINGS, TREES, DEPTH)
    if key not in _fitted:
        _fitted[key] = train(labelled_findings(spark))
    return _fitted[key]


def with_score(rows: DataFrame, forest: Forest) -> DataFrame:
    """Adds score, the share of trees that vote for a secret, by the features x."""
    model = rows.sparkSession.sql(f"SELECT from_json(m, '{MODEL}') AS _m FROM VALUES (:m) AS v(m)", args={"m": json.dumps(forest)})
    m, x = F.col("_m"), F.col("x")
    step = lambda n, _: F.when(F.get(x, F.get(m["feature"], n)) <= F.get(m["threshold"], n), F.get(m["low"], n)).otherwise(F.get(m["high"], n))
    votes = F.aggregate(m["roots"], F.lit(0.0), lambda a, r: a + F.get(m["vote"], F.aggregate(m["steps"], r, step)))
    return rows.crossJoin(F.broadcast(model)).withColumn("score", votes / len(forest["roots"])).drop("_m", "x")  # one row


def scan(docs: DataFrame, forest: Forest | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """Every candidate: doc_id, tk, word_no, piece_no, path, value, score, is_secret."""
    forest = forest or default_forest(docs.sparkSession)
    found = with_features(candidates(docs, id_col, text_col, path_col), dictionary(corpus_words(docs, text_col)))
    return with_score(found, forest).select("doc_id", "tk", "word_no", "piece_no", "path", "value", "score", (F.col("score") > THRESHOLD).alias("is_secret"))


def redact(docs: DataFrame, forest: Forest | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", mask: str = "[SECRET]") -> DataFrame:
    """The input's rows with secrets masked in the text, wherever they stand as whole runs of letters and digits; n_chars, if there is such a column, follows."""
    key = lambda i, t: F.xxhash64(i, i.isNull(), t)
    found = scan(docs, forest, id_col, text_col, path_col).where("is_secret")
    # As many values as a document holds; the longest first, as one may hold another.
    found = found.groupBy(key(F.col("doc_id"), F.col("tk")).alias("k"), "tk").agg(F.sort_array(F.collect_set(F.struct(F.length("value").alias("n"), "value")), asc=False)["value"].alias("secrets"))
    tk = text_key(F.col(text_col))
    rows = with_row(docs, k=key(F.col(id_col), tk), tk=tk).join(found, ["k", "tk"], "left")
    text = F.col(f"_row.`{text_col}`")
    literal = lambda s: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.replace(s, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}])"))
    masked = F.aggregate(F.coalesce("secrets", F.array().cast("array<string>")), text, lambda t, s: F.regexp_replace(t, literal(s), F.lit(mask)))
    out = rows.select("_row", F.when(F.col("secrets").isNull(), text).otherwise(masked).alias("_text"), F.col("secrets").isNotNull().alias("_changed"))
    each = []
    for c in docs.columns:
        column = F.col(f"_row.`{c}`")
        if c == text_col:
            column = F.col("_text")
        elif c == "n_chars":
            column = F.when(F.col("_changed"), F.length("_text").cast(docs.schema[c].dataType)).otherwise(column)
        each.append(column.alias(c))
    return out.select(*each)


def query(spark, sf_dir):
    found = scan(documents(spark, sf_dir))
    return found.select("doc_id", "word_no", "piece_no", "path", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")
