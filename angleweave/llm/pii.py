"""Personal data and information-theoretic sanitisation, in DataFrame operations only.

Base spans (e-mail, IP, card, phone) come from fixed patterns. Java gives matches but no
places, so a text is split at the same pattern and the lengths of pieces and matches
are added up. The patterns are the contract's with possessive repeats, which cannot
change a match here and keep long runs from recursing; where a run of one class could be
entered at every character, a look-behind lets it be entered at its start or at the end of
the match before only.

The method then protects the values found, and declared entities (patterns; strings like keys by default), whose spans are
added as terms of full disclosure. A term in the text of a value reveals it by their pointwise mutual information over
the corpus, counted in documents: log2(p(e|t) / p(e)), where p(e) = n(e) / N and p(e|t) = (n(t,e) + EVIDENCE p(e)) /
(n(t) + EVIDENCE), so that few meetings are drawn towards chance but none is passed over. Its share of the value's whole
information -log2 p(e) is the disclosure: at REMOVE or above the term is removed, at GENERALISE or above it is replaced by a
class word. n(t), n(e), n(t,e) and N count all documents over whole texts, and every value counts. Every occurrence of the
term is changed, in the documents that hold the value only. Values that the same documents hold are rated once, so that a list
of values makes no pairs of its own. Values are masked before words are taken, so a word that a span touches is no term.

Defined cases: null text is empty; texts without values have no spans; an empty list
digests the empty string; a null doc_id is carried; repeated rows count as documents; a value that all documents hold
tells nothing and has disclosure 0; very long texts are read whole; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD, broadcast_if_small, stored, text_of

KINDS = ("email", "ip", "card", "phone")
#: Fixed by contract.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
CLASS_WORDS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}

#: Pseudo-documents by which a term's meetings with an entity are drawn towards chance.
EVIDENCE = 1.0
GENERALISE = 0.75
REMOVE = 0.9
#: Declared entities: a guard, the pattern, and what must hold of a match x. The default takes opaque strings such as keys and tokens.
_SECRET = r"[A-Za-z0-9_+=]"
DECLARED = ((rf"{_SECRET}{{20}}", rf"(?<!{_SECRET}){_SECRET}{{20,}}+", "x.value rlike '[0-9].*[0-9]' and x.value rlike '[A-Za-z].*[A-Za-z]'"),)
EDGE = ".,;:!?()[]{}\"'*#$%&|<>"


def _sql(pattern: str) -> str:
    return "r'" + pattern + "'"


def _placed(text: str, pattern: str, matches: str) -> str:
    """array<struct<start, end, value>> of the matches, from the lengths of the pieces between them."""
    gaps = f"transform(split({text}, {_sql(pattern)}, -1), x -> char_length(x))"
    step = "named_struct('at', s.at + get(s.gaps, i) + char_length(get(s.found, i)), 'gaps', s.gaps, 'found', s.found, 'out', concat(s.out, array(named_struct('start', s.at + get(s.gaps, i), 'end', s.at + get(s.gaps, i) + char_length(get(s.found, i)), 'value', get(s.found, i)))))"
    start = f"named_struct('at', 0, 'gaps', {gaps}, 'found', {matches}, 'out', cast(array() as array<struct<start:int,end:int,value:string>>))"
    return f"aggregate(sequence(0, size({matches}) - 1), {start}, (s, i) -> {step}, s -> s.out)"


def _digits(value: str) -> str:
    return rf"regexp_replace({value}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    digit = f"cast(substr({d}, char_length({d}) - i + 1, 1) as int)"
    doubled = f"({digit} * 2 - if({digit} > 4, 9, 0))"
    return f"aggregate(sequence(1, char_length({d})), 0, (a, i) -> a + if(i % 2 = 1, {digit}, {doubled})) % 10 = 0"


def _valid(kind: str, value: str = "x.value") -> str:
    if kind == "ip":
        return rf"forall(split({value}, '[.]'), p -> char_length(ltrim('0', p)) <= 3 and coalesce(try_cast(right(p, 9) as int), 0) <= 255)"
    if kind == "card":
        d = _digits(value)
        return f"case when char_length({d}) between 12 and 19 then {_luhn(d)} else false end"
    if kind == "phone":
        return f"char_length({_digits(value)}) between 9 and 15"
    return "true"


EMPTY = "cast(array() as array<struct<start:int,rank:int,end:int,value:string>>)"


def base_spans(docs: DataFrame) -> DataFrame:
    """docs and spans, array<struct<start, rank, end, value>> by start, then kind."""
    rows = docs
    for k in KINDS:
        rows = rows.withColumn(f"__m_{k}", F.expr(f"if(__text rlike {_sql(GUARDS[k])}, regexp_extract_all(__text, {_sql(PATTERNS[k])}, 0), cast(array() as array<string>))"))
    for rank, k in enumerate(KINDS):
        placed = f"transform(filter({_placed('__text', PATTERNS[k], f'__m_{k}')}, x -> {_valid(k)}), x -> named_struct('start', x.start, 'rank', {rank}, 'end', x.end, 'value', x.value))"
        rows = rows.withColumn(f"__s_{k}", F.expr(f"if(size(__m_{k}) > 0, {placed}, {EMPTY})"))
    rows = rows.withColumn("spans", F.array_sort(F.concat(*[F.col(f"__s_{k}") for k in KINDS])))
    return rows.drop(*[f"__m_{k}" for k in KINDS], *[f"__s_{k}" for k in KINDS])


def _joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in (*KINDS, "term")) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat(get({names}, x.rank), ':', x.start, ':', x.end)), ',')")


def term_of(word: str) -> str:
    edge = EDGE.replace("'", "\\'").replace('"', '\\"')
    return f"lower(trim(both '{edge}' from {word}))"


#: Stands for a character of a span; a noncharacter, as long as what it replaces.
MASK = "\uffff"


def _declared(rows: DataFrame, declared: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """Adds declared, the spans of the declared entities that touch no base span."""
    parts = []
    for k, (guard, pattern, valid) in enumerate(declared):
        rows = rows.withColumn(f"__d_{k}", F.expr(f"if(__text rlike {_sql(guard)}, regexp_extract_all(__text, {_sql(pattern)}, 0), cast(array() as array<string>))"))
        placed = f"transform(filter({_placed('__text', pattern, f'__d_{k}')}, x -> ({valid}) and not exists(spans, s -> s.start < x.end and x.start < s.end)), x -> named_struct('start', x.start, 'rank', {len(KINDS)}, 'end', x.end, 'value', x.value))"
        rows = rows.withColumn(f"__p_{k}", F.expr(f"if(size(__d_{k}) > 0, {placed}, {EMPTY})")).drop(f"__d_{k}")
        parts.append(f"__p_{k}")
    return rows.withColumn("declared", F.array_sort(F.array_distinct(F.concat(F.expr(EMPTY), *parts)))).drop(*parts)


def _masked(rows: DataFrame) -> DataFrame:
    """Adds masked, the text with its spans masked character by character; null without spans."""
    step = f"if(x.end <= s.at, s, named_struct('at', x.end, 'out', concat(s.out, substring(__text, s.at + 1, x.start - s.at), repeat('{MASK}', x.end - greatest(x.start, s.at)))))"
    masked = f"aggregate(array_sort(concat(spans, declared)), named_struct('at', 0, 'out', ''), (s, x) -> {step}, s -> concat(s.out, substring(__text, s.at + 1)))"
    return rows.withColumn("masked", F.expr(f"if(size(spans) + size(declared) > 0, {masked}, null)"))


def found(docs: DataFrame, declared: tuple[tuple[str, str, str], ...] = DECLARED) -> DataFrame:
    """One row per document, written: rid, doc_id, spans, declared, masked."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text_of().alias("__text"))
    return stored(_masked(_declared(base_spans(rows), declared)).drop("__text"), "pii-found")


def _terms(text: str) -> str:
    return f"array_distinct(transform(split({text}, {_sql(SPACE_CLASS)}), w -> {term_of('w')}))"


def held_values(rows: DataFrame) -> DataFrame:
    """rid, entity, n_entity, written. Values that the same documents hold are interchangeable here and count as one entity."""
    held = rows.filter("masked is not null").select("rid", F.explode(F.expr("array_distinct(transform(concat(spans, declared), s -> s.value))")).alias("value"))
    held = stored(held, "pii-values")
    sets = held.groupBy("value").agg(F.count(F.lit(1)).alias("n_entity"), F.bit_xor(F.xxhash64("rid")).alias("a"), F.bit_xor(F.xxhash64(F.lit("b"), "rid")).alias("b"))
    sets = stored(sets.select("value", "n_entity", F.xxhash64("n_entity", "a", "b").alias("entity")), "pii-sets")
    return stored(held.join(broadcast_if_small(sets, sets.count()), "value").select("rid", "entity", "n_entity").distinct(), "pii-held")


def disclosures(rows: DataFrame, held: DataFrame, docs: DataFrame) -> DataFrame:
    """entity, term, disclosure of the pairs at or above GENERALISE, from all documents."""
    values = held.groupBy("rid").agg(F.collect_list(F.struct("entity", "n_entity")).alias("es"))
    pairs = rows.filter("masked is not null").join(values, "rid").select("es", F.explode(F.expr(f"filter({_terms('masked')}, t -> char_length(t) >= 3 and not contains(t, '{MASK}'))")).alias("term"))
    pairs = pairs.select("term", F.explode("es").alias("e")).groupBy("e.entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.first("e.n_entity").alias("n_entity"))
    pairs = stored(pairs, "pii-pairs")
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure"))
    total = float(rows.count())
    # Counted before they are joined: a term of many documents is one row a task.
    counts = docs.select(F.explode(F.expr(_terms("coalesce(text, '')"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    rated = pairs.join(counts, "term")
    share = F.col("n_entity") / F.lit(total)
    given = (F.col("n_both") + F.lit(EVIDENCE) * share) / (F.col("n_term") + F.lit(EVIDENCE))
    whole = -F.log2(share)
    rated = rated.withColumn("disclosure", F.when(whole > 0, F.log2(given / share) / F.when(whole > 0, whole)).otherwise(F.lit(0.0)))
    return rated.filter(F.col("disclosure") >= GENERALISE).select("entity", "term", "disclosure")


def revealing_terms(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rid and terms, array<struct<start, rank, end, removed>>: the spans of revealing terms."""
    held = held_values(rows)
    rated = stored(disclosures(rows, held, docs), "pii-disclosures")
    # What a term discloses most in a document decides.
    hits = held.join(broadcast_if_small(rated, rated.count()), "entity").groupBy("rid", "term").agg(F.max("disclosure").alias("disclosure"))
    hits = stored(hits, "pii-hits")
    texts = rows.join(hits.select("rid").distinct(), "rid", "left_semi").select("rid", "masked")
    # Words and the gaps before them: a word starts after all earlier pieces.
    texts = texts.select("rid", F.expr(f"regexp_extract_all(masked, {_sql('(' + WORD + ')')}, 1)").alias("words"), F.expr(f"split(masked, {_sql(WORD)}, -1)").alias("gaps"))
    words = texts.select("rid", F.posexplode(F.expr("transform(words, (w, i) -> named_struct('word', w, 'gap', char_length(get(gaps, i))))")).alias("i", "w")).select("rid", "i", "w.word", (F.col("w.gap") + F.char_length("w.word")).alias("size"))
    words = words.withColumn("end", F.sum("size").over(Window.partitionBy("rid").orderBy("i")).cast("int")).withColumn("start", F.col("end") - F.char_length("word"))
    at = words.filter(~F.contains("word", F.lit(MASK))).select("rid", "start", "end", F.expr(term_of("word")).alias("term")).join(hits, ["rid", "term"])
    one = F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", (F.col("disclosure") >= REMOVE).alias("removed"))
    return at.groupBy("rid").agg(F.array_sort(F.collect_list(one)).alias("terms"))


NO_SPANS = "cast(array() as array<struct<start:int,rank:int,end:int>>)"


def _plain(spans: str) -> str:
    return f"transform({spans}, s -> named_struct('start', s.start, 'rank', s.rank, 'end', s.end))"


def personal_data(docs: DataFrame, declared: tuple[tuple[str, str, str], ...] = DECLARED) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms (declared entities and revealing terms)."""
    rows = found(docs, declared)
    terms = stored(revealing_terms(rows, docs.select("text")), "pii-spans")
    rows = rows.select("rid", "doc_id", "spans", "declared").join(terms, "rid", "left")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.rank = {r})) as bigint)").alias(f"n_{k}") for r, k in enumerate(KINDS)]
    every = F.expr(f"array_sort(concat({_plain('spans')}, {_plain('declared')}, coalesce({_plain('terms')}, {NO_SPANS})))")
    n_terms = F.expr("cast(size(declared) + if(terms is null, 0, size(terms)) as bigint)")
    rows = rows.select("doc_id", *counts, F.sha2(F.encode(_joined("spans"), "UTF-8"), 256).alias("base_sha256"), every.alias("__all"), n_terms.alias("n_terms"))
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", _joined("__all").alias("spans"), "n_terms")


def sanitised(docs: DataFrame, declared: tuple[tuple[str, str, str], ...] = DECLARED) -> DataFrame:
    """doc_id and text, with values and revealing terms replaced by class words or removed, row by row; a null text stays null."""
    docs = stored(docs.select("doc_id", F.col("text").cast("string"), F.monotonically_increasing_id().alias("__row")), "pii-docs")
    rows = found(docs.select(F.col("__row").alias("doc_id"), "text"), declared)
    terms = revealing_terms(rows, docs.select("text"))
    marks = "array(" + ", ".join(f"'{CLASS_WORDS[k]}'" for k in (*KINDS, "term")) + ")"
    cuts = rows.select("rid", F.col("doc_id").alias("__row"), "spans", "declared").join(terms, "rid", "left")
    one = lambda x, mark: f"named_struct('start', {x}.start, 'rank', {x}.rank, 'end', {x}.end, 'mark', {mark})"
    nothing = "cast(array() as array<struct<start:int,rank:int,end:int,mark:string>>)"
    cuts = cuts.withColumn("cuts", F.expr(f"array_sort(concat(transform(spans, s -> {one('s', f'get({marks}, s.rank)')}), transform(declared, d -> {one('d', chr(39) * 2)}), coalesce(transform(terms, t -> {one('t', f'if(t.removed, {chr(39) * 2}, get({marks}, t.rank))')}), {nothing})))"))
    cuts = cuts.filter("size(cuts) > 0").select("__row", "cuts")
    joined = docs.join(cuts, "__row", "left").withColumn("__text", text_of())
    step = "named_struct('at', greatest(s.at, c.end), 'text', s.text, 'out', if(c.start >= s.at, concat(s.out, substring(s.text, s.at + 1, c.start - s.at), c.mark), s.out))"
    clean = f"aggregate(cuts, named_struct('at', 0, 'text', __text, 'out', ''), (s, c) -> {step}, s -> concat(s.out, substring(s.text, s.at + 1)))"
    return joined.select("doc_id", F.expr(f"if(cuts is null, text, {clean})").alias("text"))
