"""Secrets in texts: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimlens.llm.matches import DOCUMENT, gaps_and_matches, placed, rewritten
from dimlens.llm.storage import stored

#: Words that neighbour secrets, and words that neighbour harmless keys.
CREDENTIAL = ("password passwd passphrase pwd secret token apikey api key auth authorization bearer "
              "credential credentials private access login signature").split()
HARMLESS = ("commit sha sha1 sha256 md5 digest checksum hash etag uuid guid id revision build version "
            "example sample dummy placeholder test fixture card phone order invoice").split()

_RUN = "A-Za-z0-9+_.-"
#: A name whose last part holds a word for credentials, and a sign of assignment; then what may stand
#: before the value. A name is tried once, from where its run of characters starts.
_NAME = (rf"(?:[{_RUN}]*+/)*+(?>[{_RUN}]*?(?<![A-Za-z0-9])(?i:{'|'.join(CREDENTIAL)})(?![A-Za-z0-9]))"
         rf"[{_RUN}]*+[\"']?+")
NAMED = (rf"(?<![/{_RUN}])(?=[/{_RUN}]++[\"']?+[\x20\t]*+[=:]){_NAME}[\x20\t]*+[=:]{{1,3}}+>?+[\x20\t]*+[\"']?+"
         r"(?:(?i:bearer|basic)[\x20\t]++)?+(?=\S)")


def _quoted(quote: str) -> str:
    """What is quoted, to the end of the quotation, or without one to the next blank."""
    inside = rf"(?:\\[^\r\n]|[^{quote}\\\r\n])"
    opened = rf"(?<={quote}(?:(?i:bearer|basic)\x20)?)"
    return rf"{opened}{inside}{{4,}}+(?={quote})|(?<={quote})(?!{inside}*+{quote})\S{{4,}}+"


#: The value of such a name: all that is quoted or up to the next blank, unless it is the next name.
VALUE = (rf"(?!{_NAME}(?:[\x20\t]++[=:]|[=:]{{1,3}}+>?+[\x20\t]))"
         rf"(?:{_quoted(chr(34))}|{_quoted(chr(39))}|(?<![\"'])(?![\"'])\S{{4,}}+)")
#: A run of the characters of keys: long ones with a digit, in capitals only or in mixed case, and
#: shorter ones right after a sign of assignment. It starts where the run of characters does.
RUN_OF_KEY = (r"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*+[0-9]|[A-Z]{16}|[A-Z+/_-]*+[a-z+/_-]++[A-Z])"
              r"[A-Za-z0-9+/_-]{16,}={0,2}|(?<=[=:][\x20]{0,1}[\"']{0,1})[A-Za-z0-9+/_-]{8,}+={0,2})")
#: A password in an address, after the name of its user.
LOGIN = r"(?<![A-Za-z0-9+/_.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s/:@?#\"'<>]*+:"
PASSWORD = r"[^\s/?#\"'<>]+(?=@[A-Za-z0-9\[])"
#: A signed token: its parts belong together. It may end a path.
FOLDERS = r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+_-]*+/)*+"
SIGNED = r"eyJ[A-Za-z0-9_-]{4,}+(?:[.][A-Za-z0-9_-]{4,}+){2,4}+"
#: What may be a secret, in some forms with what it follows; that is PREFIX.
CANDIDATE = rf"(?:{NAMED}{VALUE}|{LOGIN}{PASSWORD}|{FOLDERS}{SIGNED}|{RUN_OF_KEY})"
PREFIX = rf"^(?:{NAMED}|{LOGIN}|{FOLDERS}(?={SIGNED}))"
#: Forms that issuers of keys publish.
ISSUED = (r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"
          rf"|sk-[A-Za-z0-9_-]{{20,}}|AIza[0-9A-Za-z_-]{{35}}|glpat-[A-Za-z0-9_-]{{20,}}|{SIGNED})$")
#: Neighbours that only a path or the name of a host has: a backslash, the ending of a file after
#: slashes, or a scheme before.
FILE = (r"(rlike(before, '[\\\\]$') or rlike(after, '^[\\\\][A-Za-z0-9]')"
        r" or contains(value, '/') and rlike(after, '^[.][a-z]{1,4}(?![A-Za-z0-9])')"
        r" or rlike(value, '^//[^/]*$') and endswith(before, ':') and not startswith(after, '@'))")
#: Parts of a document's path that speak against a real secret.
EXAMPLE_PATH = r"(?i)test|example|sample|fixture|vendor|docs?/|lock"
WORD = r"(?<!\S)\p{L}{3,}(?=[.,;:!?]?(?!\S))"
FEATURES = ("length", "transitions", "digits", "upper", "hexadecimal", "distinct", "entropy", "coverage",
            "slashes", "in_path", "in_file", "example_path", "credential", "harmless", "assigned", "quoted", "issued",
            "login")


def candidates(documents: DataFrame) -> DataFrame:
    """(doc_id, content, path, start, end, value, form, before, after): what may be a secret in whole texts.

    Places count code points, the end excluded; ``before`` and ``after`` are the 48 characters on
    either side, and ``path`` is the column source, if there is one. ``form`` is "named" for the whole
    value assigned to a word for credentials: what is quoted, or all up to the next blank, from four
    characters on, and "login" for a password in an address. It is empty for signed tokens of three or
    more parts and for other runs of the characters of keys.
    """
    path = F.col("source").cast("string") if "source" in documents.columns else F.lit(None).cast("string")
    named = documents.select("doc_id", "text", F.coalesce(path, F.lit("")).alias("path"))
    text = F.coalesce(F.col("text"), F.lit(""))
    named = named.select("doc_id", F.xxhash64(text).alias("content"), "path", text.alias("text"))
    some = named.where(F.rlike("text", F.lit(CANDIDATE)))
    found = some.select(*DOCUMENT, "path", gaps_and_matches("text", F.lit(CANDIDATE)).alias("m"))
    each = F.expr("""filter(transform(m.found, (v, i) -> struct(i as n, m.gaps[i] as gap, v as value,
        left(coalesce(get(m.gaps, i + 1), ''), 48) as after)), x -> x.value <> '')""")
    rows = found.select(*DOCUMENT, "path", F.explode(each).alias("m")).select(*DOCUMENT, "path", "m.*")
    prefix = F.regexp_extract("value", PREFIX, 0)
    before = F.concat("gap", "prefix")
    rows = rows.withColumn("prefix", prefix).select(
        *DOCUMENT, "path", "n", F.char_length(before).alias("gap"),
        F.expr("substring(value, char_length(prefix) + 1)").alias("value"),
        F.expr("case when prefix = '' or endswith(prefix, '/') then '' when rlike(prefix, '://[^=]*:$') then 'login'"
               " else 'named' end").alias("form"), F.right(before, F.lit(48)).alias("before"), "after")
    return placed(rows, [*DOCUMENT])


def _coverage(documents: DataFrame, found: DataFrame, documents_with: int) -> DataFrame:
    """(value, covered): letters of a value that stand in it as words of the corpus.

    A word counts if at least ``documents_with`` documents hold it, apart from keys.
    """
    runs = found.select("value").distinct().select("value", F.explode(F.regexp_extract_all(
        F.lower("value"), F.lit(r"[a-z]{3,}"), F.lit(0))).alias("word"))
    runs = stored(runs, "runs")
    words = documents.select(F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower("text"), F.lit(WORD), F.lit(0)))).alias("word"))
    known = words.join(stored(runs.select("word").distinct(), "wanted"), "word", "left_semi").groupBy("word").agg(
        F.count("*").alias("n")).where(F.col("n") >= documents_with).select("word")
    return runs.join(stored(known, "dictionary"), "word").groupBy("value").agg(
        F.sum(F.char_length("word")).alias("covered"))


def _words_in(text: str, words: list[str]) -> str:
    return f"cast(rlike({text}, '(?i)(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])') as double)"


def with_features(documents: DataFrame, found: DataFrame, documents_with: int = 5) -> DataFrame:
    """Candidates with the columns of FEATURES."""
    n = "char_length(value)"

    def share(characters: str) -> str:
        return f"cast(regexp_count(value, '[{characters}]') as double) / {n}"

    changes = "(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"
    count = f"({n} - char_length(replace(value, c, '')))"
    expressions = {
        "length": f"cast({n} as double)",
        "transitions": f"cast(regexp_count(value, '{changes}') as double) / {n}",
        "digits": share("0-9"), "upper": share("A-Z"), "hexadecimal": share("0-9a-f"),
        "distinct": f"cast(size(letters) as double) / {n}",
        "entropy": f"-aggregate(letters, 0D, (s, c) -> s + {count} / {n} * log2({count} / {n}))",
        "coverage": f"coalesce(covered, 0) / {n}",
        "slashes": "cast(regexp_count(value, '/') as double)",
        "in_path": "cast(form <> 'login' and (rlike(before, '[/.@\\\\\\\\]$')"
                   " or rlike(after, '^[/.@\\\\\\\\][A-Za-z0-9]')) as double)",
        "in_file": f"cast({FILE} as double)",
        "example_path": f"cast(rlike(path, '{EXAMPLE_PATH}') as double)",
        "credential": f"if(form = 'named', 1D, {_words_in('right(before, 24)', CREDENTIAL)})",
        "harmless": _words_in("right(before, 24)", HARMLESS),
        "assigned": "if(form = 'named', 1D, cast(rlike(before, '[=:]\\\\s?[\"\\']?$') as double))",
        "quoted": "cast(rlike(before, '[\"\\']$') as double)",
        "issued": f"cast(rlike(value, '{ISSUED}') as double)",
        "login": "cast(form = 'login' as double)",
    }
    covered = _coverage(documents, found, documents_with)
    joined = found.join(stored(covered, "covered"), "value", "left").withColumn(
        "letters", F.array_distinct(F.split("value", "")))
    return joined.select(*DOCUMENT, "start", "end", "value",
                         *(F.expr(e).alias(f) for f, e in expressions.items()))


def plain_findings(measured: DataFrame) -> DataFrame:
    """Labelled findings for a corpus without any: cases that their form or neighbours decide.

    1: the published form of an issuer's key or of a signed token, a password in an address that is
    not mostly words, or a value with digits assigned to a word for credentials. 0: digits only, letters
    only away from such words, hardly any different characters, mostly words of the corpus, a part of a
    file's path or host's name away from such words, or a value beside a word for harmless keys. A dot or
    an @ beside a value alone decides nothing.
    """
    no = ("digits = 1 or distinct < 0.2 or coverage > 0.6"
          " or (credential = 0 and (in_file = 1 or harmless = 1 or digits + upper = 0))")
    yes = "(credential = 1 and assigned = 1 and digits > 0.1)"
    label = F.expr(f"""case when issued = 1 or (login = 1 and coverage <= 0.6) then 1D when login = 1 then null
        when {no} then 0D when {yes} then 1D end""")
    return measured.withColumn("label", label).where("label is not null")


def training_rows(known: DataFrame, findings: int) -> DataFrame:
    """(FEATURES, label, weight): equal rows as one with their number, at most ``findings`` of either label.

    Those are taken whose features hash lowest, so copies fill no sample and neither label is left out.
    """
    merged = stored(known.groupBy(*FEATURES, "label").agg(F.count("*").cast("double").alias("weight")), "merged")
    either = [merged.where(F.col("label") == label).orderBy(F.xxhash64(*FEATURES), *FEATURES).limit(findings)
              for label in (0, 1)]
    return either[0].unionByName(either[1])


def scan(documents: DataFrame, labelled: DataFrame | None = None, findings: int = 20000,
         threshold: float = 0.5, trees: int = 20, depth: int = 6, seed: int = 7) -> DataFrame:
    """(doc_id, content, start, end, value, probability, is_secret): one row per candidate.

    A random forest decides on a candidate's length, changes between kinds of characters,
    characters, coverage by words of the corpus, path, and neighbouring words. It is trained on
    ``labelled``, rows of doc_id, start and label (0 or 1) from an earlier review, or without them
    on the cases that ``plain_findings`` decides; see ``training_rows`` for ``findings``. If all labels are alike, so are all decisions; without any, no candidate is
    removed.

    Null and empty texts have no candidates; rows that share a doc_id are searched each by itself,
    and equal rows count once. An empty table gives an empty result.
    """
    found = stored(candidates(documents), "candidates")
    measured = stored(with_features(documents, found), "measured")
    if labelled is None:
        known = plain_findings(measured)
    else:
        reviewed = labelled.select(F.col("doc_id").alias("_id"), F.col("start").alias("_start"),
                                   F.col("label").cast("double").alias("label")).where("label in (0, 1)")
        known = measured.join(reviewed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("start") == F.col("_start")))
    known = stored(training_rows(known, findings), "known")
    classes = sorted(r["label"] for r in known.select("label").distinct().collect())
    assembler = VectorAssembler(inputCols=[*FEATURES], outputCol="_features")
    if len(classes) == 2:
        forest = RandomForestClassifier(featuresCol="_features", labelCol="label", probabilityCol="_probability",
                                        rawPredictionCol="_raw", predictionCol="_predicted",
                                        weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)
        model = forest.fit(assembler.transform(known))
        scored = model.transform(assembler.transform(measured)).withColumn(
            "probability", vector_to_array("_probability")[1])
    else:
        scored = measured.withColumn("probability", F.lit(classes[0] if classes else 1.0))
    return scored.select(*DOCUMENT, "start", "end", "value", "probability",
                         (F.col("probability") >= threshold).cast("int").alias("is_secret"))


def redacted(documents: DataFrame, found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every secret in their texts replaced; all their columns are kept."""
    spans = found.where("is_secret = 1").select(*DOCUMENT, "start", "end", F.lit(mark).alias("replacement"))
    return rewritten(documents, spans)
