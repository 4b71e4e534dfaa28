"""SQL fragments for the twins of the text functions (DuckDB dialect)."""

from __future__ import annotations

from markbook.config import DEFAULT
from markbook.functions import text as tx

# The token rules as the SQL engine writes them.
TOKEN = tx.TOKEN.replace("'", "''")
NEGATION = tx.NEGATION.replace("'", "''")
CLITIC = tx.CLITIC.replace("'", "''")


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def tokens(text: str) -> str:
    spaced = f"regexp_replace({text}, '{NEGATION}', '\\1 \\2', 'g')"
    spaced = f"regexp_replace({spaced}, '{CLITIC}', ' \\1', 'g')"
    return f"regexp_extract_all({spaced}, '{TOKEN}')"


def sentences(text: str) -> str:
    return (
        f"(len(regexp_extract_all({text}, '[.!?]+(?:\\s|$)')) + case when "
        f"regexp_replace({text}, '^(?:[\\s\\S]*[.!?]+(?:\\s|$))?\\s*', '') <> '' then 1 else 0 end)"
    )


def syllables(word: str) -> str:
    groups = f"len(regexp_extract_all(lower({word}), '[aeiouy]+'))"
    return (
        f"greatest(1, {groups} - case when lower({word}) like '%e' and {groups} > 1 then 1 else 0 end)"
    )


def metrics(text: str, prefix: str, source: str, columns: str = "*") -> str:
    """A select adding word, sentence and syllable counts, grade, average and verdict."""
    p = prefix
    return f"""
  select *, {p}_grade between 2 and 4 and {p}_average <= 15 and {p}_words <= 200 as {p}_ok
  from (select *, case when {p}_words = 0 or {p}_sentences = 0 then 0::double else
          greatest(0::double, 0.39::double * ({p}_words::double / {p}_sentences)
            + 11.8::double * ({p}_syllables::double / {p}_words) - 15.59::double) end as {p}_grade,
        {p}_words::double / greatest(1, {p}_sentences) as {p}_average
    from (select * exclude ({p}_tokens), len({p}_tokens) as {p}_words,
            coalesce(list_sum([{syllables('w')} for w in {p}_tokens]), 0)::bigint as {p}_syllables
      from (select {columns}, {tokens(text)} as {p}_tokens, {sentences(text)} as {p}_sentences from {source})))
"""


def advice(p: str) -> str:
    """Reading advice as a list without nulls."""
    return f"""list_filter([
      case when {p}_grade > 4 then '{tx.TOO_COMPLEX}' when {p}_grade < 2 then '{tx.TOO_SIMPLE}' end,
      case when {p}_average > 15 then '{tx.LONG_SENTENCES}' end,
      case when {p}_words > 200 then '{tx.LONG_TEXT}' end], lambda m: m is not null)"""


def contains_any(text: str, words) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


def indicators(text: str) -> str:
    return ", ".join(f"{contains_any(text, w)} as {name}" for name, w in tx.INDICATORS.items())


def topic_score(text: str, ok: str) -> str:
    hits = " ".join(
        f"- (case when contains({text}, '{w}') then 0.3::double else 0::double end)"
        for w in tx.UNSUITABLE_TOPICS
    )
    return (
        f"greatest(0::double, least(1::double, 1::double {hits} + (case when "
        f"{contains_any(text, tx.SUITABLE_TOPICS)} then 0.2::double else 0::double end) "
        f"- (case when {ok} then 0::double else 0.2::double end)))"
    )


def organization(text: str, s: str) -> str:
    return (
        f"case when {s} < 2 then 0.3::double else least(1::double, 0.5::double + "
        f"case when {contains_any(f'lower({text})', tx.TRANSITIONS)} then 0.3::double else 0::double end + "
        f"case when {s} >= 3 then 0.2::double else 0::double end) end"
    )


def language_quality(text: str, w: str, s: str) -> str:
    return f"""case when {w} > 0 then (
      case when {w}::double / nullif({s}, 0) between 5 and 15 then 0.8::double else 0.5::double end
      + case when length(regexp_replace({text}, '[^\\p{{Lu}}]', '', 'g'))::double / nullif(length({text}), 0) < 0.3
          then 0.8::double else 0.5::double end
      + case when length({text}) - length(replace({text}, '.', '')) >= {s} * 0.7::double
          then 0.8::double else 0.5::double end) / 3::double else 0::double end"""


def concepts(question: str) -> str:
    return (
        f"[w for w in {tokens(f'lower({question})')} if w not in ({quoted(DEFAULT.stop_words)})]"
    )


def content_words(text: str) -> str:
    words = f"string_split(trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    return (
        f"array_to_string([w for w in {words} if w <> '' and w not in "
        f"({quoted(DEFAULT.stop_words)})], ' ')"
    )


def vector_terms(text: str) -> str:
    return (
        f"[w for w in regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}') "
        f"if w not in ({quoted(DEFAULT.vectorizer_stop_words)})]"
    )


def analysis(source: str, keep: str) -> str:
    """A select with the response analysis columns of (question_text, response) rows."""
    relevant = "len([c for c in concepts if contains(lower(response), c)]) >= greatest(1::double, len(concepts) * 0.3::double)"
    base = f"(select {keep}, question_text, coalesce(response, '') as response, {concepts('question_text')} as concepts from {source})"
    return f"""
  select * exclude (r_tokens, concepts, written, relevant),
    case when written then r_words else 0 end as word_count,
    case when written then r_sentences else 0 end as sentence_count,
    written and relevant as has_content,
    case when written then {organization('response', 'r_sentences')} else 0::double end as organization_score,
    case when not written then 0::double when relevant then 0.8::double else 0.2::double end as content_score,
    case when written then {language_quality('response', 'r_words', 'r_sentences')} else 0::double end as language_quality
  from (select *, len(r_tokens) as r_words, trim(response, ' ' || chr(9) || chr(10) || chr(13)) <> '' as written,
          {relevant} as relevant
    from (select *, {tokens('response')} as r_tokens, {sentences('response')} as r_sentences from {base}))
"""


def overall(cfg=DEFAULT) -> str:
    return (
        f"(content_score * {cfg.content_weight}::double + language_quality * {cfg.language_weight}::double "
        f"+ least(1::double, word_count::double / 30) * {cfg.completeness_weight}::double)"
    )


def extended_points(top: str) -> str:
    o = overall()
    return (
        f"case when not has_content then 0 when {o} >= 0.85 then {top} when {o} >= 0.70 then {top} - 1 "
        f"when {o} >= 0.50 then {top} - 2 when {o} >= 0.30 then 1 else 0 end"
    )


def letter(response: str) -> str:
    given = f"upper(trim({response}, ' ' || chr(9) || chr(10) || chr(13)))"
    found = f"regexp_extract({given}, '[A-D]')"
    return (
        f"case when length({given}) <= 1 then {given} when {found} <> '' then {found} "
        f"else substr({given}, 1, 1) end"
    )


def grade(percentage: str) -> str:
    p = percentage
    return f"case when {p} >= 90 then 'A' when {p} >= 80 then 'B' when {p} >= 70 then 'C' when {p} >= 60 then 'D' else 'F' end"


def pick(choices, key: str, purpose: str) -> str:
    number = f"('0x' || substr(md5({key} || '|{purpose}'), 1, 7))::bigint"
    return f"[{quoted(choices)}][{number} % {len(choices)} + 1]"
