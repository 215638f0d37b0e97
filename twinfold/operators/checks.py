"""Row and set rules. Row rules give an array of messages; set rules give rows of what breaks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import casefolded, folded, nfkc, nfkc_folded, unfenced

# Which check each issue code contradicts.
ISSUE_CHECKS = {
    "not_self_contained": "self_contained",
    "incorrect_answer": "correct_answer",
    "ambiguous_answer": "unique_answer",
    "invalid_distractor": "all_distractors_wrong",
    "implausible_distractor": "distractors_plausible",
    "equivalent_distractors": "distractors_mutually_distinct",
    "unstated_assumption": "self_contained",
    "alternative_answer": "unique_answer",
    "option_dependent": "option_independent",
    "short_answer_unsuitable": "short_answer_suitable",
    "cross_format_mismatch": "cross_format_equivalent",
    "purpose_leakage": "purpose_neutral",
    "format_leakage": "format_neutral",
    "temporally_unstable": "temporally_stable",
}
#: Hiragana, katakana and common ideographs, as they are counted in Japanese texts.
JAPANESE_LETTERS = "[ぁ-んァ-ヶ一-龯]"


def messages(*rules: tuple[Column, str | Column], most: int | None = None) -> Column:
    """The messages of the rules whose condition is true, in order (at most ``most``, which is how many are shown)."""
    out = F.array_compact(F.array(*[F.when(c, m if isinstance(m, Column) else F.lit(m)) for c, m in rules]))
    return F.slice(out, 1, most) if most else out


def violations(df: DataFrame, rules: dict[str, dict], most: int = 8) -> DataFrame:
    """``violations`` of a closed schema. rules by column: required, const, enum, pattern, minimum, maximum, min_length,
    max_length, min_items, max_items, unique. A column that isn't in the rules is one for all rows."""
    out: list[tuple[Column, str]] = [(F.lit(True), f"{c}: unknown column") for c in df.columns if c not in rules]
    for name, rule in rules.items():
        if name not in df.columns:
            if rule.get("required"):
                out.append((F.lit(True), f"{name}: required"))
            continue
        c = F.col(name)
        made = {
            "required": lambda v, c=c: c.isNull() if v else F.lit(False), "const": lambda v, c=c: c != F.lit(v), "enum": lambda v, c=c: ~c.isin(*v), "pattern": lambda v, c=c: ~c.rlike(v),
            "minimum": lambda v, c=c: c < v, "maximum": lambda v, c=c: c > v, "min_length": lambda v, c=c: F.length(c) < v, "max_length": lambda v, c=c: F.length(c) > v,
            "min_items": lambda v, c=c: F.size(c) < v, "max_items": lambda v, c=c: F.size(c) > v, "unique": lambda v, c=c: F.size(c) != F.size(F.array_distinct(c)),
        }
        out += [(made[k](v), f"{name}: {k}") for k, v in rule.items()]
    return df.withColumn("violations", messages(*out, most=most))


def distinct_answers(correct: Column, distractors: Column) -> Column:
    """Whether the answer and the distractors differ without white space around them and case folded."""
    return F.size(F.array_distinct(casefolded(F.concat(F.array(correct), distractors)))) == F.size(distractors) + 1


def repeated_keys(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def block_checks(items: DataFrame) -> DataFrame:
    """payload_block_id, n, problems of blocks that aren't complete 2x2 blocks of one payload and one purpose pair."""
    agg = items.groupBy("payload_block_id").agg(F.count("*").alias("n"), F.count_distinct("purpose", "format").alias("cells"), F.count_distinct("canonical_payload_sha256").alias("payloads"), F.count_distinct("purpose_pair_id").alias("pairs"))
    problems = messages(((F.col("n") != 4) | (F.col("cells") != 4), "cells"), (F.col("payloads") != 1, "payload"), (F.col("pairs") != 1, "pair"))
    return agg.select("payload_block_id", "n", problems.alias("problems")).where("size(problems) > 0")


def cell_counts(items: DataFrame) -> DataFrame:
    """purpose, format, n with sums (null)."""
    return items.cube("purpose", "format").agg(F.count("*").alias("n"))


def verdict_errors(df: DataFrame, verdict: str = "validation") -> DataFrame:
    """``errors``: contradictions within a structured verdict: verdict and confidence STRING, checks MAP<STRING, BOOLEAN>,
    normalized_answer STRING, normalized_distractor_answers, unstated_assumptions, reasonable_alternative_answers
    ARRAY<STRING>, invalid_distractor_indices ARRAY<INT>, equivalent_distractor_pairs ARRAY<STRUCT<first_index,
    second_index>>, issues ARRAY<STRUCT<code, message>>."""
    v = F.col(verdict)
    checks, pairs, bad, issues = v.checks, v.equivalent_distractor_pairs, v.invalid_distractor_indices, v.issues
    some = lambda c: F.size(c) > 0
    has = lambda code: F.exists(issues, lambda x: x.code == code)
    all_true = F.forall(F.map_values(checks), lambda x: x)
    clean = ~(some(bad) | some(pairs) | some(v.unstated_assumptions) | some(v.reasonable_alternative_answers) | some(issues))
    passed = v.verdict == "pass"
    # three answers are folded one by one, so that only texts beyond ASCII leave the JVM
    n = 3
    own = [folded(F.get(v.normalized_distractor_answers, F.lit(i))) for i in range(n)]
    answer = folded(v.normalized_answer)
    listed = lambda i, j: F.exists(pairs, lambda p: (p.first_index == i) & (p.second_index == j))
    equal = [(i, j, own[i] == own[j]) for i in range(n) for j in range(i + 1, n)]
    any_equal = reduce(lambda a, b: a | b, [F.coalesce(e, F.lit(False)) for _, _, e in equal])
    rules: list[tuple[Column, str | Column]] = [
        (passed & ~all_true, "pass with a failed check"),
        (passed & ~clean, "pass with findings"),
        (passed & (v.confidence != "high"), "pass without high confidence"),
        (~passed & all_true & clean, "no pass though nothing failed"),
        (some(bad) & checks["all_distractors_wrong"], "invalid distractors though all_distractors_wrong"),
        (some(pairs) & checks["distractors_mutually_distinct"], "equivalent pairs though distractors_mutually_distinct"),
        (~some(pairs) & ~checks["distractors_mutually_distinct"], "not mutually distinct without a pair"),
        (F.exists(pairs, lambda p: p.first_index >= p.second_index), "pair not in order"),
        (F.size(pairs) != F.size(F.array_distinct(pairs)), "pair repeated"),
        *[(e & ~listed(i, j), f"equal distractors {i}-{j} not listed") for i, j, e in equal],
        (any_equal & checks["distractors_mutually_distinct"], "equal distractors though distractors_mutually_distinct"),
        *[((own[i] == answer) & ~F.array_contains(bad, i), f"distractor {i} equals the answer but isn't invalid") for i in range(n)],
        (some(pairs) & ~has("equivalent_distractors"), "pairs without equivalent_distractors issue"),
        (~some(pairs) & has("equivalent_distractors"), "equivalent_distractors issue without pairs"),
        (some(v.unstated_assumptions) & checks["self_contained"], "assumptions though self_contained"),
        (some(v.unstated_assumptions) & ~has("unstated_assumption"), "assumptions without unstated_assumption issue"),
        (~some(v.unstated_assumptions) & has("unstated_assumption"), "unstated_assumption issue without assumptions"),
        (some(v.reasonable_alternative_answers) & checks["unique_answer"], "alternatives though unique_answer"),
        (some(v.reasonable_alternative_answers) & ~has("alternative_answer"), "alternatives without alternative_answer issue"),
        (~some(v.reasonable_alternative_answers) & has("alternative_answer"), "alternative_answer issue without alternatives"),
        (~checks["option_independent"] & ~has("option_dependent"), "not option_independent without option_dependent issue"),
        *[(has(code) & checks[check], f"issue {code} though {check}") for code, check in ISSUE_CHECKS.items()],
        (has("other") & all_true, "other issue though all checks pass"),
    ]
    return df.withColumn("errors", messages(*rules))


def verdict_passes(verdict: Column) -> Column:
    lists = ("invalid_distractor_indices", "equivalent_distractor_pairs", "unstated_assumptions", "reasonable_alternative_answers", "issues")
    return reduce(lambda a, c: a & (F.size(verdict[c]) == 0), lists, (verdict.verdict == "pass") & (verdict.confidence == "high") & F.forall(F.map_values(verdict.checks), lambda x: x))


def lexicon_hits(texts: DataFrame, terms: DataFrame, key: str, text: str = "text", least_word: int = 1) -> DataFrame:
    """key, term, hits: whole-word occurrences of terms (lower-case words) in any text, without a join of all with all: a
    text is cut into words, which meet the terms by equality. terms: term STRING (single words)."""
    words = F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-zà-öø-ÿ]+)"), F.lit(1)))
    each = texts.select(key, words.alias("term")).where(F.length("term") >= least_word)
    return each.join(terms.select(F.lower("term").alias("term")).distinct(), "term").groupBy(key, "term").agg(F.count("*").alias("hits"))


#: Endings with which an English cue term counts, too.
ENDINGS = "(?:s|es|ed|ing|d)?"


def term_hits(text: Column, language: Column, lexicon: dict[str, list[str]], inflected: bool = False) -> Column:
    """Every occurrence of a small lexicon's terms, as often as each occurs: in English as words, with English endings if
    inflected; in other languages anywhere. Texts and terms are compared under NFKC, English ones case-folded."""
    import re
    import unicodedata

    out = F.array().cast("array<string>")
    for lang, terms in lexicon.items():
        found = []
        for term in terms:
            name = unicodedata.normalize("NFKC", term) if lang != "en" else term.casefold()
            if lang == "en":
                n = F.regexp_count(nfkc_folded(text), F.lit(f"(?<![a-z]){re.escape(name)}{ENDINGS if inflected else ''}(?![a-z])"))
            else:
                n = F.floor((F.length(nfkc(text)) - F.length(F.replace(nfkc(text), F.lit(name), F.lit("")))) / len(name)).cast("int")
            found.append(F.array_repeat(F.lit(term), F.coalesce(n, F.lit(0))))
        if found:
            out = F.when(language == lang, F.concat(*found)).otherwise(out)
    return out


def cue_hits(texts: DataFrame, lexicon: dict[str, list[str]], key: str, inflected: bool = False) -> DataFrame:
    """key, language, hits of texts (language, text) with any: see term_hits."""
    return texts.select(key, "language", term_hits(F.col("text"), F.col("language"), lexicon, inflected).alias("hits")).where("size(hits) > 0")


def leakage_hits(df: DataFrame, key: str, visible: str, private: list[str], label: str | None = None, public: list[str] | None = None, exempt: list[str] | None = None) -> DataFrame:
    """key, fields: private fields whose value stands in the visible text (any case), and the label, as a word among ASCII
    letters. A field in ``exempt`` is none where its value is part of one of the ``public`` columns."""
    low = F.lower(visible)
    open_text = F.lower(F.concat_ws("\n", *(public or [])))
    rules = []
    for c in private:
        own = F.lower(F.col(c))
        hit = (F.length(c) > 0) & (F.instr(low, own) > 0)
        rules.append((hit & (F.instr(open_text, own) == 0) if c in (exempt or []) else hit, c))
    if label:
        rules.append(((F.length(label) > 0) & F.rlike(low, F.concat(F.lit("(?<![a-z])\\Q"), F.lower(F.col(label)), F.lit("\\E(?![a-z])"))), label))
    return df.select(key, messages(*rules).alias("fields")).where("size(fields) > 0")


def script_hits(text: Column) -> Column:
    """Problems of a Japanese text: Latin letters, full-width digits."""
    return messages((text.rlike("[A-Za-z]"), "latin letters"), (text.rlike("[\\uff10-\\uff19]"), "full-width digits"))


def content_qc(
    df: DataFrame, text: str = "text", slots: list[str] | None = None, lexicon: dict[str, list[str]] | None = None, phrases: dict[str, list[str]] | None = None,
    max_latin_share: float = 0.3, min_japanese: int = 1,
) -> DataFrame:
    """``qc_problems`` of generated texts (language, text): empty; no JSON object, in a code fence or not, of just the slots with a string
    each (where slots are given);
    an empty slot; a term of the lexicon (English ones with endings); too large a share of Latin letters, too few Japanese
    characters or full-width digits in Japanese; a phrase that gives the answer away. What follows an empty text or a wrong
    object isn't looked at. Characters are counted, and phrases sought, under NFKC."""
    import unicodedata

    t, ja = F.col(text), F.col("language") == "ja"
    empty = F.coalesce(F.btrim(t) == "", F.lit(True))
    wrong, whole, blank = F.lit(False), t, F.lit(False)
    if slots:
        inner = unfenced(t)
        own, typed = F.from_json(inner, "map<string,string>"), F.try_parse_json(inner)
        other = reduce(lambda a, b: a | b, [F.coalesce(F.schema_of_variant(F.try_variant_get(typed, f"$.{x}", "variant")) != "STRING", F.lit(True)) for x in slots])
        wrong = F.coalesce(~F.array_sort(F.map_keys(own)).eqNullSafe(F.array(*map(F.lit, sorted(slots)))), F.lit(True)) | other
        values = [F.coalesce(F.element_at(own, F.lit(x)), F.lit("")) for x in slots]
        whole, blank = F.concat_ws("\n", *values), reduce(lambda a, b: a | b, [F.btrim(x) == "" for x in values])
    df = df.withColumn("_whole", whole).withColumn("_plain", nfkc(F.col("_whole"))).withColumn("_ok", ~empty & ~wrong)
    plain = F.col("_plain")
    latin, japanese = F.regexp_count(plain, F.lit("[A-Za-z]")), F.regexp_count(plain, F.lit(JAPANESE_LETTERS))
    low = nfkc_folded(F.col("_whole"))
    rules: list[tuple[Column, str | Column]] = [
        (blank, "empty slot"), (F.size(term_hits(F.col("_whole"), F.col("language"), lexicon or {}, True)) > 0, "cue"), (ja & (F.try_divide(latin, latin + japanese) > max_latin_share), "latin share"),
        (ja & (japanese < min_japanese), "japanese characters"), (ja & F.col("_whole").rlike("[\\uff10-\\uff19]"), "full-width digits"),
        *[((F.col("language") == lang) & (F.instr(low, F.lit(unicodedata.normalize("NFKC", x).casefold())) > 0), f"phrase {x}") for lang, own in (phrases or {}).items() for x in own],
    ]
    found = F.when(empty, F.array(F.lit("empty"))).when(wrong, F.array(F.lit("not the slots"))).otherwise(messages(*rules))
    return df.withColumn("qc_problems", found).drop("_whole", "_plain", "_ok")


def fields_agree(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """A boolean column for each name: whether two columns are the same (null is the same as null)."""
    return df.withColumns({k: F.col(a).eqNullSafe(F.col(b)) for k, (a, b) in pairs.items()})


def answer_ordinal(options: Column, answer: Column) -> Column:
    """Place of the answer among the options, from 1; null without options. An answer that isn't one of them is an error."""
    at = F.array_position(options, answer)
    return F.when(options.isNull(), F.lit(None).cast("bigint")).when(at > 0, at).otherwise(F.raise_error(F.lit("the answer is none of the options")).cast("bigint"))


def length_balance(frames: DataFrame, slices: dict[str, list[str]], caps: dict[str, float]) -> DataFrame:
    """slice_kind, slice_key, gap, balanced: difference of the mean token counts of the classes; caps by slice kind."""
    from .metrics import sliced

    mean = lambda k: F.avg(F.when(F.col("class") == k, F.col("tokens")))
    agg = sliced(frames, slices).groupBy("slice_kind", "slice_key").agg((mean("evaluation") - mean("deployment")).alias("gap"))
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    return agg.withColumn("balanced", F.coalesce(F.abs("gap") <= F.element_at(cap, F.col("slice_kind")), F.lit(False)))


def locus_balance(pairs: DataFrame, loci: tuple[str, ...] = ("noun_only", "verb_only", "both"), least_families: int = 3) -> DataFrame:
    """cue_locus, pairs, families, repeated (families with the locus twice), enough."""
    each = pairs.groupBy("cue_locus", "family_id").agg(F.count("*").alias("n"))
    return each.groupBy("cue_locus").agg(F.sum("n").alias("pairs"), F.count("*").alias("families"), F.count_if(F.col("n") > 1).alias("repeated")).withColumn("enough", (F.col("families") >= least_families) & F.col("cue_locus").isin(*loci))


def span_counts(frames: DataFrame, cap: int = 2) -> DataFrame:
    """span, n of differing spans used more often than the cap. frames: spans ARRAY<STRING>."""
    return frames.select(F.explode("spans").alias("span")).groupBy("span").agg(F.count("*").alias("n")).where(F.col("n") > cap)


def control_rules(items: DataFrame, terms: dict[str, dict[str, str]], by: list[str] | None = None, pairs: int = 12, mention_pairs: tuple[int, ...] = (1, 2, 5, 6, 9), explicit: int = 16, implicit: int = 8) -> DataFrame:
    """by, level, language, key, problem of banks of lexical controls (by: what tells banks apart).

    items: control_id, control_pair_id, language, cue_family, control_type, intended_purpose, lexical_cue, cue_term, text. terms: the
    explicit term of each cue by language. Texts and terms are compared case folded. Rows: a repeated id or text; an explicit cue whose
    term isn't the language's; a term that isn't in the text, or that of another row of the pair that is; an explicit term in a text
    of an implicit cue. Pairs (lcp01 and so on, of every language): not one row of each cue; mention pairs that aren't neutral mentions;
    others that aren't crossed. Languages: the number of explicit and implicit rows."""
    by, language = by or [], [*(by or []), "language"]
    low = items.withColumn("_f", casefolded(F.array("text", "cue_term"))).withColumns({"_text": casefolded(F.array("text"))[0], "_term": F.col("_f")[1]}).drop("_f")
    known = F.create_map(*[x for k, own in terms.items() for x in (F.lit(k), F.create_map(*[F.lit(y) for cue, term in own.items() for y in (cue, term.casefold())]))])
    own_terms = F.try_element_at(known, F.col("language"))
    every = F.map_values(own_terms)
    row = messages(
        ((F.col("cue_family") == "explicit_lexeme") & ~F.col("_term").eqNullSafe(F.try_element_at(own_terms, F.col("lexical_cue"))), "not the explicit term"), (F.coalesce(F.instr("_text", F.col("_term")), F.lit(0)) == 0, "term not in text"),
        ((F.col("cue_family") == "implicit_cue") & F.exists(every, lambda x: F.instr(F.col("_text"), x) > 0), "explicit term in implicit text"),
    )
    flat = lambda df, level, key, problem: df.select(*by, F.lit(level).alias("level"), "language", F.col(key).cast("string").alias("key"), problem.alias("problem"))
    out = [flat(low.withColumn("_p", F.explode(row)), "row", "control_id", F.col("_p"))]
    for column, problem in (("control_id", "repeated id"), ("text", "repeated text")):
        again = items.groupBy(*by, column).agg(F.count("*").alias("n"), F.min("language").alias("language"), F.min("control_id").alias("_id")).where("n > 1")
        out.append(flat(again, "row", "_id", F.lit(problem)))
    # terms of a pair with how many rows have each, so that a pair of any size isn't a group of pairs of rows
    own = [*language, "control_pair_id"]
    used = low.groupBy(*own, F.col("_term").alias("_other")).agg(F.count("*").alias("_n"), F.min("control_id").alias("_one"))
    met = low.join(used, own).where((F.instr(F.col("_text"), F.col("_other")) > 0) & ((F.col("_n") > 1) | (F.col("_one") != F.col("control_id"))))
    out.append(flat(met.select(*by, "language", "control_id").distinct(), "row", "control_id", F.lit("counterpart in text")))

    number = F.explode(F.sequence(F.lit(1), F.lit(pairs)))
    wanted = items.select(*by).distinct() if by else items.sparkSession.range(1).select()
    wanted = wanted.crossJoin(F.broadcast(items.sparkSession.createDataFrame([(k,) for k in terms], "language string"))).withColumn("_k", number)
    wanted = wanted.withColumn("control_pair_id", F.format_string("lcp%02d", "_k"))
    cell = lambda purpose, cue: F.count_if((F.col("intended_purpose") == purpose) & (F.col("lexical_cue") == cue))
    found = items.groupBy(*own).agg(
        F.count("*").alias("_n"), F.count_if(F.col("lexical_cue") == "evaluation").alias("_e"), F.count_if(F.col("lexical_cue") == "deployment").alias("_d"), F.count_if((F.col("control_type") == "mention_only") & (F.col("intended_purpose") == "neutral")).alias("_m"),
        F.count_if(F.col("control_type") == "crossed_distractor").alias("_c"), cell("evaluation", "deployment").alias("_ed"), cell("deployment", "evaluation").alias("_de"),
    )
    joined = wanted.join(found, own, "left")
    mention = F.col("_k").isin(*mention_pairs)
    crossed = (F.col("_c") == F.col("_n")) & (F.col("_ed") == 1) & (F.col("_de") == 1)
    bad = F.when(~F.coalesce((F.col("_n") == 2) & (F.col("_e") == 1) & (F.col("_d") == 1), F.lit(False)), "not cue matched").when(mention & (F.col("_m") != F.col("_n")), "not neutral mention-only").when(~mention & ~crossed, "not crossed")
    out.append(flat(joined.withColumn("_p", bad).where("_p is not null"), "pair", "control_pair_id", F.col("_p")))

    size = items.groupBy(*language).agg(F.count("*").alias("_n"), F.count_if(F.col("cue_family") == "explicit_lexeme").alias("_x"), F.count_if(F.col("cue_family") == "implicit_cue").alias("_i"))
    every_language = wanted.select(*language).distinct().join(size, language, "left").na.fill(0, ["_n", "_x", "_i"])
    counts = messages((F.col("_n") != explicit + implicit, f"not {explicit + implicit} items"), ((F.col("_x") != explicit) | (F.col("_i") != implicit), f"not {explicit} explicit and {implicit} implicit items"))
    out.append(flat(every_language.withColumn("_p", F.explode(counts)), "language", "language", F.col("_p")))
    return reduce(DataFrame.unionByName, out)


def bank_balance(items: DataFrame, cell: list[str], per_cell: int) -> DataFrame:
    """cell, n of cells that don't hold per_cell rows."""
    return items.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") != per_cell)


def transfer_grid(items: DataFrame, formats: dict[str, str]) -> DataFrame:
    """scenario, class, n, problem: a scenario with another format than its own, or classes of unequal size."""
    want = F.create_map(*[F.lit(x) for kv in formats.items() for x in kv])
    agg = items.groupBy("scenario", "class").agg(F.count("*").alias("n"), F.count_if(~F.col("format").eqNullSafe(F.element_at(want, F.col("scenario")))).alias("wrong"))
    size = agg.groupBy("scenario").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return agg.join(size, "scenario").select("scenario", "class", "n", F.when(F.col("wrong") > 0, "format").when(F.col("lo") != F.col("hi"), "sizes").alias("problem"))


def config_diff(a: DataFrame, b: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """key, left, right of settings (key, value) that differ."""
    both = a.select("key", F.col("value").alias("left")).join(b.select("key", F.col("value").alias("right")), "key", "full_outer")
    return both.where(~F.col("left").eqNullSafe(F.col("right")) & ~F.col("key").isin(*ignore))


def twin_contract(rows: DataFrame, pair: str, shared: list[str], mark: str = "<<FRAME>>") -> DataFrame:
    """pair, problems of template twins: one row of each class, shared fields equal, the mark once in the body, texts that
    differ."""
    e, d = (rows.where(F.col("class") == k).select(pair, F.struct(*rows.columns).alias(k[0])) for k in ("evaluation", "deployment"))
    both = e.join(d, pair, "full_outer")
    once = lambda s: F.size(F.split(F.col(f"{s}.body"), mark)) == 2
    rules = [(F.col("e").isNull() | F.col("d").isNull(), "one class only"), *[(~F.col(f"e.{c}").eqNullSafe(F.col(f"d.{c}")), f"{c} differs") for c in shared], (~once("e") | ~once("d"), "mark not once"), (F.col("e.text") == F.col("d.text"), "equal texts")]
    return both.select(pair, messages(*rules).alias("problems")).where("size(problems) > 0")


def localised_view(source: DataFrame, local: DataFrame, key: str, fields: list[str], pinned: str = "source_sha256") -> DataFrame:
    """key, problems of a localised table: fields that must stay, the pinned hash of the source row, full-width digits."""
    s = source.select(key, F.struct(*fields, "row_sha256").alias("s"))
    loc = local.select(key, F.struct(*fields, pinned, "text").alias("l"))
    rules = [(F.col("s").isNull() | F.col("l").isNull(), "one side only"), *[(~F.col(f"s.{c}").eqNullSafe(F.col(f"l.{c}")), f"{c} differs") for c in fields], (F.col("s.row_sha256") != F.col(f"l.{pinned}"), "source changed"), (F.col("l.text").rlike("[\\uff10-\\uff19]"), "full-width digits")]
    return s.join(loc, key, "full_outer").select(key, messages(*rules).alias("problems")).where("size(problems) > 0")


def factor_balance(df: DataFrame, factors: list[str]) -> DataFrame:
    """factor_1, value_1, factor_2, value_2, n for each pair of factors: one pass over the rows, without a self-join."""
    text = lambda c: F.col(c).cast("string")
    pairs = [F.struct(F.lit(a).alias("factor_1"), text(a).alias("value_1"), F.lit(b).alias("factor_2"), text(b).alias("value_2")) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    return df.select(F.explode(F.array(*pairs)).alias("p")).groupBy(F.col("p.factor_1"), F.col("p.value_1"), F.col("p.factor_2"), F.col("p.value_2")).agg(F.count("*").alias("n"))


def family_catalog(pairs: DataFrame, families: DataFrame, rows: DataFrame, cells: dict[str, list[str]]) -> DataFrame:
    """kind, key, problem of a catalog of frame families. families: family_id, holdout_fold; pairs: pair_id, family_id, the
    columns of cells, evaluation, deployment, content_spec_id; rows (containers): pair_id, class, family_id, the columns of
    cells, text; cells: the values of each column.

    Family ids and folds are one to one; pair ids are unique and their families known; each family has one pair in each
    cell; each pair has a container of each class that mirrors it; frame texts are unique; the pairs of a content
    specification are of two families."""
    names = [*cells]
    text = lambda c: F.col(c).cast("string")
    twice = lambda df, c, kind, what: df.groupBy(text(c).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(kind).alias("kind"), "key", F.lit(what).alias("problem"))
    found = [twice(families, "family_id", "family", "repeated"), twice(families, "holdout_fold", "fold", "several families"), twice(pairs, "pair_id", "pair", "repeated")]
    n = pairs.groupBy("family_id", *names).agg(F.count("*").alias("n"))
    grid = families.select("family_id").distinct()
    for c, values in cells.items():
        grid = grid.withColumn(c, F.explode(F.array(*map(F.lit, values))))
    both = grid.withColumn("wanted", F.lit(1)).join(n, ["family_id", *names], "full_outer")
    problem = F.when(F.col("wanted").isNull(), "cell unknown").when(F.col("n").isNull(), "cell empty").when(F.col("n") > 1, "cell with several pairs")
    found.append(both.select(F.lit("family").alias("kind"), F.concat_ws("/", "family_id", *names).alias("key"), problem.alias("problem")).where("problem is not null"))
    wanted = pairs.select("pair_id", F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.col(k).alias("text")) for k in ("evaluation", "deployment")])).alias("w"), F.struct("family_id", *names).alias("_own")).select("pair_id", "w.class", F.col("w.text").alias("_text"), "_own")
    own = rows.select("pair_id", "class", "text", F.struct("family_id", *names).alias("_other"))
    mirror = wanted.join(own, ["pair_id", "class"], "full_outer")
    problem = F.when(F.col("_own").isNull(), "container without pair").when(F.col("_other").isNull(), "no container").when(~F.col("_own").eqNullSafe(F.col("_other")) | ~F.col("_text").eqNullSafe(F.col("text")), "not mirrored")
    found.append(mirror.select(F.lit("container").alias("kind"), F.concat_ws("/", "pair_id", "class").alias("key"), problem.alias("problem")).where("problem is not null"))
    found.append(twice(rows, "text", "text", "repeated"))
    spread = pairs.groupBy(text("content_spec_id").alias("key")).agg(F.count_distinct("family_id").alias("n")).where("n <> 2")
    found.append(spread.select(F.lit("content").alias("kind"), "key", F.lit("not of two families").alias("problem")))
    return reduce(DataFrame.unionByName, found)


def body_rules(body: Column, constraint: Column | None = None, kind: Column | None = None, scaffolding: Column | None = None) -> Column:
    """Problems of a template body: numbered or XML scaffolding; with the profile's columns also a constraint that
    contradicts its kind, and scaffolding other than plain."""
    rules = [(body.rlike(r"(?im)\{\{(?:N|番号)\}\}|\bItem\s+\d+\s+of\s+\d+\b|^\s*\d+[.)]\s"), "numbered"), (body.rlike("</?[A-Za-z][^>]*>"), "markup")]
    if constraint is not None and kind is not None:
        rules.append(((constraint == "unconstrained") != (kind == "none"), "constraint"))
    if scaffolding is not None:
        rules.append((scaffolding != "plain", "scaffolding"))
    return messages(*rules)


def corpus_shape(topics: DataFrame, containers: DataFrame, domains: int = 8, per_domain: int = 5, specs: int = 10, container_ids: list[str] | None = None) -> DataFrame:
    """problem, key, n: a wrong number of topics, of domains or of topics in a domain (key), of content specifications
    (containers: spec_id, container_id), and container ids that are missing, unknown or repeated (c01 to c40 by default)."""
    ids = container_ids or [f"c{i:02d}" for i in range(1, 41)]
    row = lambda df, name: df.select(F.lit(name).alias("problem"), F.lit(None).cast("string").alias("key"), "n")
    each = topics.groupBy(F.col("domain").cast("string").alias("key")).agg(F.count("*").alias("n"))
    have = containers.groupBy(F.col("container_id").cast("string").alias("key")).agg(F.count("*").alias("n"))
    want = topics.sparkSession.createDataFrame([(x, 1) for x in ids], "key string, wanted int")
    both = want.join(have, "key", "full_outer").select(F.lit("container ids").alias("problem"), "key", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "wanted").where("wanted is null or n <> 1").drop("wanted")
    return (
        row(topics.agg(F.count("*").alias("n")).where(F.col("n") != domains * per_domain), "topics").unionByName(row(each.agg(F.count("*").alias("n")).where(F.col("n") != domains), "domains"))
        .unionByName(each.where(F.col("n") != per_domain).select(F.lit("domain").alias("problem"), "key", "n")).unionByName(row(containers.agg(F.count_distinct("spec_id").alias("n")).where(F.col("n") != specs), "specs")).unionByName(both)
    )


def audit_requests(df: DataFrame, key: str, text: str, private: list[str], limit_tokens: int) -> DataFrame:
    """key, problems of request texts in one pass: leaked private fields, scripts, too long."""
    from ..functions.scalars import token_estimate

    low = F.lower(text)
    rules = [*[((F.length(c) > 0) & (F.instr(low, F.lower(F.col(c))) > 0), f"leaks {c}") for c in private], ((F.col("language") == "ja") & (F.size(script_hits(F.col(text))) > 0), "script"), (token_estimate(F.col(text), F.col("language")) > limit_tokens, "too long")]
    return df.select(key, messages(*rules).alias("problems")).where("size(problems) > 0")


def evidence_gate(reports: DataFrame, current: DataFrame) -> DataFrame:
    """report, problems: a report that didn't pass, or whose hashes (name, sha256) aren't the current ones."""
    both = reports.join(current.select("name", F.col("sha256").alias("_now")), "name", "left")
    return both.groupBy("report").agg(F.array_compact(F.array(F.when(~F.bool_and("passed"), "not passed"), F.when(~F.bool_and(F.col("sha256").eqNullSafe(F.col("_now"))), "stale"))).alias("problems"))


def joint_cells(results: DataFrame, keys: list[str]) -> DataFrame:
    """The cells that pass in all models, if analysis and thresholds are the same in all results and no model comes twice."""
    same = results.agg((F.count_distinct("analysis_sha256", "thresholds_sha256") == 1).alias("_same"))
    twice = results.groupBy("model", *keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("_most"))
    from .matching import intersect_pass

    return intersect_pass(results, keys).crossJoin(F.broadcast(same)).crossJoin(F.broadcast(twice)).where("_same and _most = 1").select(*keys)


def fit_inputs(items: DataFrame, controls: DataFrame, cell: list[str], per_cell: int, control_cell: list[str], per_control: int) -> DataFrame:
    """table, problem, n: wrong cell sizes, and texts that are in both tables."""
    bad = lambda df, c, n, name: bank_balance(df, c, n).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit("cell size").alias("problem"), "n")
    both = items.select("text").intersect(controls.select("text")).agg(F.count("*").alias("n")).select(F.lit("both").alias("table"), F.lit("shared text").alias("problem"), "n")
    return bad(items, cell, per_cell, "items").unionByName(bad(controls, control_cell, per_control, "controls")).unionByName(both).where("n > 0")


def disjoint_texts(**corpora: DataFrame) -> DataFrame:
    """text, corpora of texts that are in more than one corpus."""
    rows = reduce(DataFrame.unionByName, [df.select("text", F.lit(k).alias("corpus")) for k, df in corpora.items()])
    return rows.groupBy("text").agg(F.array_sort(F.collect_set("corpus")).alias("corpora")).where("size(corpora) > 1")


def accepted_complete(states: DataFrame, planned: DataFrame) -> DataFrame:
    """job_id, problem of accepted jobs whose selected attempt isn't complete: attempts ARRAY<STRUCT<attempt_index,
    pair_results ARRAY<STRUCT<pair_id, passed>>>>; planned: job_id, pair_ids."""
    own = F.get(F.filter("attempts", lambda a: a.attempt_index == F.col("selected")), F.lit(0))
    rows = states.where("status = 'accepted'").withColumn("_own", own).join(planned, "job_id", "left")
    pairs = F.transform(F.col("_own.pair_results"), lambda p: p.pair_id)
    problem = F.when(F.col("_own").isNull(), "no selected attempt").when(~F.forall(F.col("_own.pair_results"), lambda p: p.passed), "failed pair").when(~F.array_sort(pairs).eqNullSafe(F.array_sort("pair_ids")), "pairs differ from plan")
    return rows.select("job_id", problem.alias("problem")).where("problem is not null")


def container_rules(df: DataFrame) -> DataFrame:
    """container_id, problems: declared slots aren't those of the body in order; a multiple-choice container without four
    option slots and a key."""
    found = F.array_distinct(F.regexp_extract_all("body", F.lit(r"\{\{([a-z_0-9]+)\}\}"), F.lit(1)))
    options = F.size(F.filter("slots", lambda s: s.startswith("option_")))
    mc = F.col("contract") == "multiple_choice"
    problems = messages((~found.eqNullSafe(F.col("slots")), "slots"), (mc & (options != 4), "options"), (mc & ~F.array_contains("slots", "answer_key"), "key"))
    return df.select("container_id", problems.alias("problems")).where("size(problems) > 0")


def container_view(source: DataFrame, local: DataFrame, fields: list[str], mapped: dict[str, dict[str, str]], version: str) -> DataFrame:
    """container_id, problems of localised containers against their sources, both with container_id, body, slots
    ARRAY<STRING>, the fields that must stay, and the mapped columns (for each the local word of each source word; slots word by
    word); the source with row_sha256, the local one with source_sha256 and catalog_version."""
    s, t = source.select("container_id", F.struct("*").alias("s")), local.select("container_id", F.struct("*").alias("l"))
    words = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    own = F.array_distinct(F.regexp_extract_all("l.body", F.lit(r"\{\{([^{}]+)\}\}"), F.lit(1)))
    rules: list[tuple[Column, str | Column]] = [(F.col("s").isNull() | F.col("l").isNull(), "one side only"), *[(~F.col(f"s.{c}").eqNullSafe(F.col(f"l.{c}")), f"{c} differs") for c in fields]]
    for c, m in mapped.items():
        known = words(m)
        want = F.transform("s.slots", lambda x: F.element_at(known, x)) if c == "slots" else F.element_at(known, F.col(f"s.{c}"))  # noqa: B023
        rules.append((~F.col(f"l.{c}").eqNullSafe(want), f"{c} not the local form"))
    rules += [(~own.eqNullSafe(F.col("l.slots")), "slots of the body"), (F.col("l.catalog_version") != version, "catalog version"), (~F.col("l.source_sha256").eqNullSafe(F.col("s.row_sha256")), "source changed"), (F.col("l.body").rlike("[\\uff10-\\uff19]"), "full-width digits")]
    return s.join(t, "container_id", "full_outer").select("container_id", messages(*rules).alias("problems")).where("size(problems) > 0")


def frame_rules(text: Column, attributions: dict[str, str], kind: Column, directives: tuple[str, ...] = ()) -> Column:
    """Problems of a frame sentence: attribution of its class missing, not one sentence, markup, slots, format directives."""
    want = F.element_at(F.create_map(*[F.lit(x) for kv in attributions.items() for x in kv]), kind)
    return messages((F.instr(F.lower(text), F.lower(want)) == 0, "attribution"), (F.regexp_count(text, F.lit("[.!?。](?:\\s|$)")) != 1, "sentences"), (text.rlike("[<>*_#`]"), "markup"), (text.rlike(r"\{\{"), "slot"), *[(F.instr(F.lower(text), F.lit(d.lower())) > 0, f"directive {d}") for d in directives])


def lexicon_rules(terms: DataFrame) -> DataFrame:
    """language, term, problem of a lexicon (language, scope, term): empty, repeated in its scope, narrow but not broad."""
    n = terms.groupBy("language", "scope", F.lower("term").alias("term")).agg(F.count("*").alias("n"))
    bad = n.select("language", "term", F.when(F.coalesce(F.btrim("term"), F.lit("")) == "", "empty").when(F.col("n") > 1, "repeated").alias("problem")).where("problem is not null")
    narrow = n.where("scope = 'narrow'").join(n.where("scope = 'broad'"), ["language", "term"], "left_anti").select("language", "term", F.lit("narrow but not broad").alias("problem"))
    return bad.unionByName(narrow)


def variant_rules(frames: DataFrame, cap: int = 2) -> DataFrame:
    """frame_id, problems, notes of candidate frames of implicit pairs (evaluation, deployment, language, cue_locus). The places in which
    a pair differs are the larger number of text spans of the two sides: two at least for the locus ``both``, exactly one for any other. A span
    that one side of more than ``cap`` places of a language has is a problem of all its frames, one at the cap a note."""
    from ..functions.scalars import diff_spans

    rows = frames.withColumn("_spans", diff_spans("evaluation", "deployment", "language"))
    rows = rows.withColumns({f"_{k}": F.filter(F.col(f"_spans.{k}"), lambda x: x != "") for k in ("left", "right")})
    sides = F.expr("transform(_left, x -> named_struct('side', 'left', 'span', x)) || transform(_right, x -> named_struct('side', 'right', 'span', x))")
    each = rows.select("frame_id", "language", F.explode(sides).alias("s")).select("frame_id", "language", "s.*")
    # the cap is a number of places, so a span of millions of frames is one row here
    often = each.groupBy("language", "side", "span").agg(F.count("*").alias("_n")).where(F.col("_n") >= cap)
    met = each.join(often, ["language", "side", "span"]).groupBy("frame_id").agg(F.bool_or(F.col("_n") > cap).alias("_over"), F.bool_or(F.col("_n") == cap).alias("_at"))
    n = F.greatest(F.size("_left"), F.size("_right"))
    wrong = F.when(F.col("cue_locus") == "both", n < 2).otherwise(n != 1)
    out = rows.join(met, "frame_id", "left")
    out = out.select("frame_id", messages((n == 0, "no difference"), (wrong, "locus"), (F.col("_over"), "span cap")).alias("problems"), messages((F.col("_at"), "span at the cap")).alias("notes"))
    return out.where("size(problems) > 0 or size(notes) > 0")


def accepted_manifest(states: DataFrame, stored: DataFrame) -> DataFrame:
    """job_id, problem: accepted jobs that the stored manifest (job_id, content_sha256) lacks, has besides, or has otherwise."""
    from .render import reconstruct_diff

    return reconstruct_diff(stored.select("job_id", "content_sha256"), states.where("status = 'accepted'").select("job_id", "content_sha256"), "job_id")
