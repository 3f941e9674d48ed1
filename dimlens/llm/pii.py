"""Personal data: fixed patterns, and the terms that give away what they protect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dimlens.llm.matches import DOCUMENT, gaps_and_matches, placed, rewritten, same_document, with_content
from dimlens.llm.storage import stored

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: What each kind looks like. A match can only start where its first run of characters
#: does, or where the match before it ends, and takes whole runs, so no character is tried twice.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to be searched at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
LETTERS = r"\p{L}+"
GENERALISED, REMOVED = 1, 2


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _valid(kind: str) -> str:
    """SQL condition on value: what a match has to meet beyond its pattern."""
    digits = _digits("value")
    if kind == "ip":
        part = "ltrim('0', p)"
        return f"forall(split(value, '[.]'), p -> length({part}) <= 3 and coalesce(try_cast({part} as int), 0) <= 255)"
    if kind == "card":
        doubled = f"cast(substring(reverse({digits}), i, 1) as int) * if(i % 2 = 0, 2, 1)"
        luhn = f"aggregate(sequence(1, length({digits})), 0L, (s, i) -> s + ({doubled}) div 10 + ({doubled}) % 10)"
        return f"length({digits}) between 16 and 19 and {luhn} % 10 = 0"
    if kind == "phone":
        return f"length({digits}) between 8 and 15"
    return "true"


def _words(text: str, last: bool, window: int) -> str:
    """SQL: the last or first words of letters of a text."""
    found = f"regexp_extract_all({text}, '{LETTERS}', 0)".replace("\\", "\\\\")
    return f"slice({found}, if({str(last).lower()}, greatest(1, size({found}) - {window - 1}), 1), {window})"


def _without_letters(matched: str) -> str:
    """SQL: the text that was matched, other characters in place of the letters in its matches."""
    letters = "".join(map(chr, (*range(65, 91), *range(97, 123))))
    return (f"array_join(zip_with({matched}.gaps, {matched}.found,"
            f" (g, v) -> concat(g, translate(v, '{letters}', '{'_' * len(letters)}'))), '')")


def base_spans(documents: DataFrame, window: int = 8) -> DataFrame:
    """(doc_id, content, kind, start, end, value, terms): matches of the patterns in whole texts.

    Places count code points, the end excluded. ``terms`` are the ``window`` words before and the
    ``window`` words after, as far as the text has them: matches that are no personal data end
    nothing, and the personal data in between is passed over.
    """
    def matched(kind: str, when: Column) -> Column:
        return gaps_and_matches("text", F.lit(PATTERNS[kind]), when)

    # Only e-mail addresses hold letters, and no other pattern asks for any: without them in the text
    # the others match the same, and their gaps hold no words of addresses.
    texts = with_content(documents).select("*", matched("email", F.contains("text", F.lit("@"))).alias("email"))
    texts = texts.withColumn("text", F.expr(f"if(size(email.found) = 0, text, {_without_letters('email')})"))
    searched = F.array(*(F.struct(F.lit(k).alias("kind"), (
        F.col("email") if k == "email" else matched(k, F.rlike("text", F.lit(HINTS[k])))).alias("m")) for k in KINDS))
    kinds = texts.select(*DOCUMENT, F.explode(searched).alias("s")).select(
        *DOCUMENT, "s.kind", "s.m.gaps", "s.m.found").where("exists(found, v -> v <> '')")
    each = F.expr(f"""transform(found, (v, i) -> struct(i as n, char_length(gaps[i]) as gap, v as value,
        {_words('gaps[i]', True, window)} as last, {_words('gaps[i]', False, window)} as first))""")
    rows = kinds.select(*DOCUMENT, "kind", F.explode(each).alias("m")).select(*DOCUMENT, "kind", "m.*")
    valid = F.expr(" or ".join(f"(kind = '{k}' and {_valid(k)})" for k in KINDS))
    # Gaps with words are numbered, so the words beside a match are in that many gaps at most.
    some = F.size("last") > 0
    own = Window.partitionBy(*DOCUMENT, "kind")
    gaps = placed(rows, [*DOCUMENT, "kind"]).withColumn("gap", F.sum(some.cast("long")).over(own.orderBy("start")))
    near = own.orderBy("gap")
    before = F.flatten(F.collect_list(F.when(some, F.col("last"))).over(near.rangeBetween(1 - window, 0)))
    after = F.flatten(F.collect_list(F.when(some, F.col("first"))).over(near.rangeBetween(1, window)))
    around = gaps.withColumns({"last": F.reverse(F.slice(F.reverse(before), 1, window)), "first": F.slice(after, 1, window)})
    return around.where((F.col("value") != "") & valid).select(
        *DOCUMENT, "kind", "value", "end", "start", F.concat("last", "first").alias("terms"))


def _entity() -> Column:
    """What a match protects, spelled one way."""
    return F.concat_ws(":", "kind", F.when(F.col("kind").isin("card", "phone"), F.expr(_digits("value")))
                       .otherwise(F.lower("value")))


def disclosing_terms(documents: DataFrame, spans: DataFrame, generalise: float = 0.85,
                     remove: float = 0.95, support: int = 2, letters: int = 3) -> DataFrame:
    """(doc_id, content, term, action): the terms beside personal data that give it away.

    The information of a protected entity c is IC(c) = -log2 p(c), over the documents of the corpus,
    and a term t tells PMI(t; c) = log2 p(t, c) / (p(t) p(c)) of it, where t and c occur together
    if t is among the words beside c. A term that tells the share ``remove`` of IC(c) or more is
    removed, from the share ``generalise`` on it is generalised. Pairs found together in fewer than
    ``support`` documents, and words of fewer than ``letters`` letters, are no evidence.
    """
    beside = spans.select(*DOCUMENT, _entity().alias("entity"),
                          F.explode("terms").alias("term")).withColumn("term", F.lower("term"))
    pairs = stored(beside.where(F.char_length("term") >= letters).distinct(), "pairs")
    together = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support)
    together = stored(together, "together")
    entities = spans.select(*DOCUMENT, _entity().alias("entity")).distinct().groupBy("entity").agg(
        F.count("*").alias("n_entity"))
    wanted = stored(together.select("term").distinct(), "terms")
    words = documents.select(F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower("text"), F.lit(LETTERS), F.lit(0)))).alias("term"))
    terms = words.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    n = max(documents.count(), 1)
    told = F.log2(F.col("n_both") * n / F.col("n_term") / F.col("n_entity"))
    information = F.log2(F.lit(float(n)) / F.col("n_entity"))
    graded = together.join(terms, "term").join(entities, "entity").select(
        "entity", "term", F.when((information > 0) & (told >= remove * information), REMOVED)
        .when((information > 0) & (told >= generalise * information), GENERALISED).alias("action"))
    telling = stored(graded.where(F.col("action").isNotNull()), "telling")
    return pairs.join(telling, ["entity", "term"]).groupBy(*DOCUMENT, "term").agg(F.max("action").alias("action"))


def _as_spans(base: DataFrame) -> DataFrame:
    return base.select(*DOCUMENT, "kind", "start", "end", F.lit(None).cast("int").alias("action"),
                       F.lit(False).alias("capital"))


def term_spans(documents: DataFrame, terms: DataFrame, base: DataFrame) -> DataFrame:
    """(doc_id, content, kind, start, end, action, capital): a document's terms outside base spans.

    Terms are found whatever their case; where letters fold together that lower case keeps apart, such
    as a long s, the action is that of the term they match.
    """
    own = stored(terms.groupBy(*DOCUMENT).agg(
        F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("actions")), "own")
    documents = with_content(documents)
    texts = documents.join(own, same_document(documents, own)).select(
        documents["doc_id"], documents["content"], "text", "actions")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.map_keys("actions"), "|"), F.lit(r")(?!\p{L})"))
    found = texts.select(*DOCUMENT, "actions", gaps_and_matches("text", pattern).alias("m"))
    each = F.expr("""filter(transform(m.found, (v, i) -> struct(i as n, char_length(m.gaps[i]) as gap,
        v as value, coalesce(actions[lower(v)], array_max(transform(filter(map_entries(actions), e ->
        rlike(v, concat('(?iu)^(?:', e.key, ')$'))), e -> e.value))) as action)), x -> x.value <> '')""")
    rows = found.select(*DOCUMENT, F.explode(each).alias("m")).select(*DOCUMENT, "m.*")
    capital = F.rlike("value", F.lit(r"^\p{Lu}"))
    places = placed(rows, [*DOCUMENT]).select(*DOCUMENT, F.lit(TERM).alias("kind"), "start", "end", "action",
                                              capital.alias("capital"))
    every = places.unionByName(_as_spans(base))
    order = Window.partitionBy(*DOCUMENT).orderBy("start")
    fixed = F.col("kind") != TERM
    before = F.max(F.when(fixed, F.col("end"))).over(order)
    after = F.min(F.when(fixed, F.col("start"))).over(order.rangeBetween(0, Window.unboundedFollowing))
    apart = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return every.withColumn("apart", apart).where((F.col("kind") == TERM) & F.col("apart")).drop("apart")


def all_spans(documents: DataFrame, window: int = 8, **thresholds) -> DataFrame:
    """(doc_id, content, kind, start, end, action, capital): base spans, and terms that give them away.

    ``action`` is null for base spans, and says for terms whether they are generalised or removed.
    ``window`` is that of ``base_spans``, the thresholds those of ``disclosing_terms``.
    """
    base = stored(base_spans(documents, window), "base_spans")
    terms = stored(disclosing_terms(documents, base, **thresholds), "disclosing")
    return _as_spans(base).unionByName(term_spans(documents, terms, base))


def find(documents: DataFrame, window: int = 8, **thresholds) -> DataFrame:
    """(doc_id, spans), one row per row of documents: spans is an array of (kind, start, end, action).

    Sorted by kind as listed, terms last, then by start. Null and empty texts have no spans; rows
    that share a doc_id are searched each by itself, and rows without one like any other. An empty
    table gives an empty result. Spans of different kinds may overlap.
    """
    rank = F.array_position(F.array(*map(F.lit, (*KINDS, TERM))), F.col("kind"))
    spans = all_spans(documents, window, **thresholds).withColumn("rank", rank)
    listed = F.sort_array(F.collect_list(F.struct("rank", "start", "end", "kind", "action"))).alias("spans")
    own = stored(spans.groupBy(*DOCUMENT).agg(listed), "own_spans")
    keys = with_content(documents).select(*DOCUMENT)
    joined = keys.join(own, same_document(keys, own), "left").drop(own["doc_id"], own["content"])
    none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint, action: int>>")
    return joined.select("doc_id", F.coalesce(F.transform("spans", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        s["action"].alias("action"))), none).alias("spans"))


def sanitise(documents: DataFrame, window: int = 8, **thresholds) -> DataFrame:
    """The documents with personal data in their texts replaced; all their columns are kept.

    A base span becomes its kind in brackets. A generalised term becomes ``[name]`` if it starts
    with a capital and ``[term]`` otherwise; a removed one goes. Overlapping spans are replaced
    together, by the kind of the first. Null texts stay null.
    """
    order = Window.partitionBy(*DOCUMENT).orderBy("start", F.desc("end"), "kind")
    before = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    apart = all_spans(documents, window, **thresholds).withColumn("apart", (F.col("start") >= before).cast("int"))
    joint = apart.withColumn("group", F.sum("apart").over(order)).groupBy(*DOCUMENT, "group").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.min_by(F.struct("kind", "action", "capital"), F.struct("start", -F.col("end"), "kind")).alias("first"))
    replacement = F.when(F.col("first.action").isNull(), F.concat(F.lit("["), "first.kind", F.lit("]"))).when(
        F.col("first.action") == REMOVED, "").when(F.col("first.capital"), "[name]").otherwise("[term]")
    return rewritten(documents, joint.select(*DOCUMENT, "start", "end", replacement.alias("replacement")))
