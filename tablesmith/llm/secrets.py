"""Secret scans: candidate strings and a random forest that tells secrets from look-alikes, with expressions only.

A candidate is a run of at least 16 key characters that holds a digit, or any value of at least 6 characters assigned to a
credential's name (to the closing quote, or to the next space; no digit needed). Every text is cut at its candidates once; the pieces before
and after a candidate are its neighbourhood. Features: length; kinds of characters and how often they change along the
candidate; likelihood of its character pairs under ordinary text; share covered by words of the dictionary; the path
(the name it is assigned to); and the words beside it. The pair counts and the dictionary are taken from the findings
the forest is fitted on, all of them labelled.

Findings are labelled rows (text, start marks, verdict) given by the caller; ``weak_findings`` derives them from formats
that identify themselves (an access-key prefix, an assignment to a credential's name; bare numbers as the other kind).
The forest is fitted on at most ``fit_rows`` findings, chosen by a hash of the candidate, and on the fixed findings of
``known_findings``, which have the same weight in every table: both kinds are always there. Every candidate's score is the
forest's probability; formats only make labels for the fit.

Defined results: null and empty texts have no candidates; equal candidates with equal neighbours score alike; repeated
rows give repeated findings; labelled findings of one kind, or none, leave the other kind to the fixed findings; labels
other than 0 and 1 are left out; an empty table gives an empty one; further columns stay, whatever their names.
"""

from __future__ import annotations

import json
import math
import random
import string
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import fresh, quoted, saved, text_key

KEY_CHARS = r"A-Za-z0-9+/_\-"
#: A whole run of at least 16 key characters with a digit in it.
CANDIDATE = rf"(?<![{KEY_CHARS}])(?=[A-Za-z+/_\-]{{0,200}}[0-9])[{KEY_CHARS}]{{16,}}={{0,2}}"
#: What is assigned to a credential's name: a quoted value, else all up to a space but closing punctuation. The short
#: looks behind come first, so most places of a text are left at once.
ASSIGNED = (r"(?<=[=: \t\"'>])(?<=[=:>][ \t]{0,8}[\"']?)(?<=(?i:pass(?:word|wd|phrase)?|secret|token|api[_ \-]?key|access[_ \-]?key|credential|auth|bearer|private)"
            r"[A-Za-z0-9_.\-]{0,32}[\"']?[ \t]{0,8}(?:=>|:=|[=:])[ \t]{0,8}[\"']?)(?![\s\"'=:>])"
            r"(?:(?<=\")[^\"\r\n]{6,}(?=\")|(?<=')[^'\r\n]{6,}(?=')|[^\s\"']{5,}[^\s\"'.,;:)\]}>])")
#: Marks that cut a text at its candidates; a text's own are blanked in the working copy.
OPEN, CLOSE = "\x01", "\x02"
NEIGHBOUR_CHARS = 64
CREDENTIAL_WORDS = r"(?i)pass(?:word|wd|phrase)?|secret|token|api[_ -]?key|access[_ -]?key|credential|auth|bearer|private"
IDENTIFIER_WORDS = r"(?i)card|order|invoice|phone|commit|sha|md5|uuid|version|isbn|account|number"


@dataclass(frozen=True)
class Forest:
    trees: int = 20
    depth: int = 6
    fit_rows: int = 20_000
    threshold: float = 0.5
    seed: int = 11


def cut(text: Column) -> Column:
    """A text in pieces: even ones (from 0) lie between candidates, odd ones are candidates."""
    plain = F.translate(F.coalesce(text, F.lit("")), OPEN + CLOSE, "  ")
    return F.split(F.regexp_replace(plain, f"({ASSIGNED}|{CANDIDATE})", f"{OPEN}$1{CLOSE}"), f"[{OPEN}{CLOSE}]")


def candidates(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(doc, place, candidate, before, after): one row for every candidate; place is its number in the text."""
    pieces = docs.select(quoted(id).alias("doc"), cut(quoted(text)).alias("pieces")).filter(F.size("pieces") > 1)
    found = F.transform(
        F.sequence(F.lit(1), ((F.size("pieces") - 1) / 2).cast("int")),
        lambda k: F.struct(k.cast("int").alias("place"), F.get("pieces", (2 * k - 1).cast("int")).alias("candidate"),
                           F.right(F.get("pieces", (2 * k - 2).cast("int")), F.lit(NEIGHBOUR_CHARS)).alias("before"),
                           F.left(F.get("pieces", (2 * k).cast("int")), F.lit(NEIGHBOUR_CHARS)).alias("after")))
    return pieces.select("doc", F.inline(found))


def path_of(before: Column) -> Column:
    """The name that the candidate is assigned to, empty without one."""
    return F.regexp_extract(before, r"([A-Za-z0-9_.\-]+)[\"']?[ \t]{0,8}(?:=>|:=|[=:])[ \t]{0,8}[\"']?$", 1)


def weak_findings(found: DataFrame) -> DataFrame:
    """Candidates that their format or path identifies, with ``label`` 1 (secret) or 0 (bare number)."""
    return found.withColumn("label", format_label()).filter(F.col("label").isNotNull())


def format_label() -> Column:
    """1 or 0 where format or path identifies a candidate, else null. A path alone doesn't identify a value without a key in it."""
    is_secret = F.col("candidate").rlike("^AKIA[A-Z0-9]{16}$") | (path_of(F.col("before")).rlike(CREDENTIAL_WORDS) & F.col("candidate").rlike(CANDIDATE))
    is_number = F.col("candidate").rlike("^[0-9]+$") & (path_of(F.col("before")) == "")
    return F.when(is_secret, 1.0).when(is_number, 0.0)


def known_findings(each: int = 12, seed: int = 3) -> list[tuple[str, str, str, float]]:
    """Fixed findings (candidate, before, after, label), ``each`` of a form; the same in every run of a seed."""
    rng = random.Random(seed)
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexes, mixed, digits = "0123456789abcdef", string.ascii_letters + string.digits, string.digits
    words = ("the report of this year was read by many people and then sent to another office where they looked at every page again before "
             "winter came while some green fields near our river stayed open for visitors with small children who wanted bread water music").split()
    prose = lambda: " ".join(rng.choice(words) for _ in range(8))
    slug = lambda mark: mark.join(rng.choice(words) for _ in range(5))
    uuid = lambda: "-".join(some(hexes, n) for n in (8, 4, 4, 4, 12))
    secrets = [lambda: ('token = "', some(hexes, 40), '"'), lambda: ("password=", some(hexes, rng.randrange(16, 33)), " "), lambda: ("api_key: '", some(mixed, 32), "'"),
               lambda: ("secret=", some(mixed + "+/", 40), " "), lambda: (" ", "AKIA" + some(string.ascii_uppercase + digits, 16), " "),
               lambda: ("Authorization: Bearer ", some(mixed + "-_", 48), " "), lambda: (" ", "ghp_" + some(mixed, 36), " "), lambda: (" ", some(mixed + "+/", 40), " ")]
    name = lambda: rng.choice(["password=", "password: ", 'secret = "', "db_password=", "passwd: '", 'auth_token = "', '"password": "'])
    value = lambda text: (lambda before: (before, text, before[-1] if before[-1] in "\"'" else " "))(name())
    marked = lambda n: some(mixed, n - 3) + rng.choice("!@#.$%") + some(digits, 2)
    secrets += [lambda: value(marked(rng.randrange(8, 16))), lambda: value(marked(rng.randrange(16, 24))), lambda: value(some(mixed, rng.randrange(8, 16))),
                lambda: value(rng.choice(words).title() + rng.choice("!@#.$") + some(digits, rng.randrange(2, 5))), lambda: value(some(string.ascii_lowercase + digits, 10)),
                lambda: value(rng.choice(words) + rng.choice(words) + some(digits, rng.randrange(1, 4))), lambda: value(some(string.ascii_letters, rng.randrange(8, 16))),
                lambda: value(slug("-")), lambda: value(slug(".")), lambda: value(slug("_")), lambda: (rng.choice(['passphrase = "', 'password: "', 'secret = "']), slug(" "), '"')]
    plain = "required optional enabled disabled changed expired unknown missing everybody nothing string default invalid".split()
    others = [lambda: value(rng.choice(plain)), lambda: (rng.choice(["the secret: ", "private: ", "auth: ", "token: ", "password: "]), max(slug(" ").split(), key=len).ljust(6, "s"), " "),
              lambda: ("author: ", rng.choice(words).title().ljust(6, "n"), " "), lambda: ("password = ", rng.choice(["getpass()", "input()", "config.password", "self.token", "os.environ", "args.secret"]), " "),
              lambda: ("password=", rng.choice(["${PASSWORD}", "<password>", "********", "$DB_PASSWORD", "{{secret}}", "xxxxxxxx"]), " "),
              lambda: (" ", some(digits, 16), " "), lambda: (" ", some(digits, rng.randrange(17, 25)), " "), lambda: (" ", uuid(), " "), lambda: ("id=", uuid(), " "),
              lambda: ("commit ", some(hexes, 40), " "), lambda: ("sha256: ", some(hexes, 64), " "), lambda: (" ", some(hexes, 32), " "), lambda: (" ", some(hexes, 40), " "),
              lambda: (" ", some(hexes, 64), " "), lambda: (" ", f"{slug('-')}-{some(digits, 4)}", " "), lambda: (" ", f"/{some(digits, 4)}/{slug('/')}", "."),
              lambda: ("order number ", some(digits, 16), " "), lambda: ("version=", f"{slug('_')}_{some(digits, 2)}", " ")]
    return [(candidate, prose() + before, after + prose(), label) for label, forms in ((1.0, secrets), (0.0, others)) for form in forms for _ in range(each)
            for before, candidate, after in [form()]]


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


FEATURES = ["chars", "digits", "uppers", "lowers", "marks", "other_marks", "changes", "pair_likelihood", "distinct_chars", "in_dictionary", "assigned", "credential_path",
            "credential_near", "identifier_near", "quoted_value"]
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"


def _pairs(text: Column) -> Column:
    """Numbers of the pairs of neighbouring characters of the alphabet (others count as one more character)."""
    place = lambda k: F.instr(F.lit(ALPHABET), F.substring(F.lower(text), k, F.lit(1)))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda k: place(k) * F.lit(len(ALPHABET) + 1) + place(k + 1))


@dataclass(frozen=True)
class Language:
    """What the labelled findings' neighbourhoods say about ordinary text: log-likelihood of character pairs, and words."""

    pairs: tuple[float, ...]
    words: tuple[str, ...]


def learn_language(sample: DataFrame, n_words: int = 2000) -> Language:
    """From a bounded sample: (alphabet + 1)^2 pair likelihoods and at most ``n_words`` frequent words."""
    words = sample.select(F.explode(F.regexp_extract_all(F.concat_ws(" ", "before", "after"), F.lit("([A-Za-z]{4,})"), 1)).alias("word")).select(F.lower("word").alias("word"))
    size = len(ALPHABET) + 1
    counts = {r.pair: r.n for r in words.select(F.explode(_pairs(F.col("word"))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).collect()}
    rows = [sum(counts.get(a * size + b, 0) for b in range(size)) for a in range(size)]
    pairs = tuple(math.log((counts.get(a * size + b, 0) + 0.5) / (rows[a] + 0.5 * size)) for a in range(size) for b in range(size))
    frequent = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n_words)
    return Language(pairs, tuple(r.word for r in frequent.collect()))


def with_features(found: DataFrame, language: Language) -> DataFrame:
    """Candidates with the forest's features, all from the candidate and its neighbourhood."""
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    chars = F.length(c)
    changes = F.regexp_count(c, F.lit(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])")) / chars
    table = F.from_json(F.lit(json.dumps(language.pairs)), "array<double>")
    likelihood = F.aggregate(_pairs(c), F.lit(0.0), lambda total, k: total + F.coalesce(F.get(table, k), F.lit(-10.0))) / chars
    known = F.from_json(F.lit(json.dumps(language.words)), "array<string>")
    in_words = F.filter(F.regexp_extract_all(c, F.lit("([A-Z]?[a-z]{3,}|[A-Z]{4,})"), 1), lambda w: F.array_contains(known, F.lower(w)))
    near = F.concat_ws(" ", F.right(before, F.lit(32)), F.left(after, F.lit(32)))
    flag = lambda x: x.cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / chars
    return found.select(
        "*", flag(chars).alias("chars"), share("[0-9]").alias("digits"), share("[A-Z]").alias("uppers"), share("[a-z]").alias("lowers"),
        share(r"[+/_=\-]").alias("marks"), share(r"[^A-Za-z0-9+/_=\-]").alias("other_marks"), changes.alias("changes"), likelihood.alias("pair_likelihood"),
        (F.size(F.array_distinct(F.split(c, ""))) / chars).alias("distinct_chars"), (F.length(F.array_join(in_words, "")) / chars).alias("in_dictionary"),
        flag(path_of(before) != "").alias("assigned"), flag(path_of(before).rlike(CREDENTIAL_WORDS)).alias("credential_path"),
        flag(near.rlike(CREDENTIAL_WORDS)).alias("credential_near"), flag(near.rlike(IDENTIFIER_WORDS)).alias("identifier_near"),
        flag(before.rlike("[\"']$")).alias("quoted_value"))


def _as_vector(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(rows)


@dataclass(frozen=True)
class Scanner:
    """A fitted scanner."""

    language: Language
    forest: RandomForestClassificationModel
    threshold: float

    def score(self, found: DataFrame) -> DataFrame:
        """Candidates with ``score`` (0 to 1) and ``secret``."""
        scored = self.forest.transform(_as_vector(with_features(found, self.language))).withColumn("score", vector_to_array("probability")[1])
        return scored.withColumn("secret", F.col("score") >= self.threshold).select(*found.columns, "score", "secret")


def fit(labelled: DataFrame, forest: Forest = Forest()) -> Scanner:
    """A scanner from the fixed findings and labelled candidates (candidate, before, after, label), at most ``fit_rows`` different ones of them."""
    sample = saved(labelled.select("candidate", "before", "after", "label").filter(F.col("label").isin(0.0, 1.0)).distinct()
                   .orderBy(F.xxhash64("candidate", "before", "after"), "label").limit(forest.fit_rows))
    known = known_findings()
    fixed = labelled.sparkSession.range(1).select(F.inline(F.from_json(
        F.lit(json.dumps([dict(zip(("candidate", "before", "after", "label"), x)) for x in known])), "array<struct<candidate:string,before:string,after:string,label:double>>")))
    # Copies of one secret would outvote the rest: a candidate counts once among its neighbourhoods. All given findings of a
    # kind weigh as much as the fixed ones, however many there are.
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.countDistinct("candidate").alias("n")).collect()}
    share = F.lit(0.0)
    for kind, n in sizes.items():
        share = F.when(F.col("label") == kind, F.lit(sum(x[3] == kind for x in known) / n)).otherwise(share)
    given = sample.withColumn("weight", share / F.count("*").over(Window.partitionBy("candidate", "label")))
    language = learn_language(sample.unionByName(fixed))
    weighted = with_features(given.unionByName(fixed.withColumn("weight", F.lit(1.0))), language)
    model = RandomForestClassifier(numTrees=forest.trees, maxDepth=forest.depth, seed=forest.seed, weightCol="weight", cacheNodeIds=False).fit(
        _as_vector(weighted.coalesce(1)))
    return Scanner(language, model, forest.threshold)


def scan(docs: DataFrame, labelled: DataFrame | None = None, forest: Forest = Forest(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, place, candidate, before, after, score, secret) for every candidate of every document."""
    found = saved(candidates(docs, id, text))
    return fit(weak_findings(found) if labelled is None else labelled, forest).score(found)


def redact(docs: DataFrame, labelled: DataFrame | None = None, forest: Forest = Forest(), text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` in their own columns, with a mark in place of every secret. Documents are never dropped.

    Verdicts are kept by text, so copies share them; only texts with a secret are in that list.
    """
    key, places = fresh(docs, "text_key", "secret_places")
    keyed = docs.withColumn(key, text_key(quoted(text)))
    secrets = (scan(keyed.select(key, quoted(text)), labelled, forest, key, text).filter("secret")
               .groupBy(F.col("doc").alias(key)).agg(F.collect_set("place").alias(places)))
    masked = F.array_join(F.transform(cut(quoted(text)), lambda x, k: F.when((k % 2 == 1) & F.array_contains(places, ((k + 1) / 2).cast("int")), F.lit(mark)).otherwise(x)), "")
    return (keyed.join(secrets, key, "left").withColumn(text, F.when(quoted(places).isNull(), quoted(text)).otherwise(masked))
            .select(*map(quoted, docs.columns)))
