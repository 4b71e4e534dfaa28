"""Sentence ends by what the texts themselves teach."""

from __future__ import annotations

from checks import bindings as b
from checks.registry import big, query, r6
from markbook.operators import sentences

CLOSERS = """["'')\\]}’”»]"""


def _word(piece: str) -> str:
    return f"""regexp_replace(regexp_replace({piece}, '^["''(\\[{{‘“«]+', ''), '{CLOSERS}+\\z', '')"""


def _type(word: str) -> str:
    plain = f"regexp_replace(lower({word}), '[.!?,;:]+\\z', '')"
    return f"case when regexp_matches({plain}, '^[-+]?[.,]?[0-9][0-9.,]*\\z') then '##number##' else {plain} end"


def _likelihood(n12: str, n1: str, n2: str, n: str) -> str:
    def of(k: str, m: str, p: str) -> str:
        return f"({k} * ln(greatest({p}, 1e-12::double)) + ({m} - {k}) * ln(greatest(1 - {p}, 1e-12::double)))"

    alone, without = f"({n2} - {n12})", f"greatest({n} - {n1}, 1::double)"
    p, p1, p2 = f"({n2} / {n})", f"({n12} / {n1})", f"({alone} / {without})"
    return f"(-2 * ({of(n12, n1, p)} + {of(alone, without, p)} - {of(n12, n1, p1)} - {of(alone, without, p2)}))"


LEARNT = f"""
texts as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x09-\\x0D\\x20]+'), lambda w: w <> '') as w from documents),
pieces as (select doc_id, piece, regexp_matches(piece, '[.!?]{CLOSERS}*\\z') as is_marked, case when is_marked then following end as following
  from (select doc_id, unnest(w) as piece, unnest(list_append(w[2:], null)) as following from texts where len(w) > 0)),
words as (select *, {_type('word')} as type, {_type('next')} as next_type, length(word) - length(regexp_replace(word, '[.!?]+\\z', '')) as marks,
    case when marks = 1 and ends_with(word, '.') then '.' when marks > 0 then '!' end as ends
  from (select doc_id, is_marked, {_word('piece')} as word, {_word('following')} as next from pieces)),
counts as (select type, count(*) filter (ends = '.') as with_period, count(*) filter (ends is distinct from '.') as without_period
  from words group by type),
sums as (select sum(with_period)::double as periods, sum(with_period + without_period)::double as words from counts),
rated as (select type, with_period, without_period, with_period::double as a, without_period::double as rest, periods / words as p,
    length(type) - length(replace(type, '.', '')) as dots, length(type) - dots as letters
  from counts, sums where with_period > 0 and regexp_matches(type, '\\p{{L}}')),
short as (select * from (select type, with_period, without_period,
    -2 * (a * ln(greatest(p, 1e-12::double)) + rest * ln(greatest(1 - p, 1e-12::double)) - a * ln(0.99::double) - rest * ln(1 - 0.99::double))
    * exp(-letters::double) * (dots + 1) * pow(greatest(letters, 1)::double, -rest) as score from rated) where score >= 0.3),
marked as (select w.*, (ends = '.') and (s.type is not null or regexp_matches(word, '^\\p{{Lu}}\\.\\z')) as is_short
  from words w left join short s on s.type = w.type where ends is not null),
begun as (select next_type as type, count(*) as starts from marked where not is_short and regexp_matches(next_type, '^\\p{{L}}') group by next_type),
begin_rated as (select b.type, c.with_period + c.without_period as n, starts, starts::double / e.ends as share, s.words,
    {_likelihood('starts::double', 'e.ends', '(c.with_period + c.without_period)::double', 's.words')} as score
  from begun b join counts c using (type), sums s, (select sum(starts)::double as ends from begun) e),
starters as (select * from begin_rated where score >= 30 and share > n / words),
both_n as (select type, next_type, count(*) as n from marked
  where (is_short or (type = '##number##' and ends = '.')) and regexp_matches(next_type, '[\\p{{L}}#]') and next_type not in (select type from starters)
  group by type, next_type having count(*) > 1),
together as (select * from (select b.type, b.next_type, b.n, (f.with_period + f.without_period)::double as n1, (g.with_period + g.without_period)::double as n2,
    s.words, {_likelihood('b.n::double', 'n1', 'n2', 's.words')} as score
  from both_n b join counts f on f.type = b.type join counts g on g.type = b.next_type, sums s) where score >= 7.88 and n / n1 > n2 / words),
opened as (select distinct m.word, m.next from marked m left join starters s on s.type = m.next_type
  left join together t on t.type = m.type and t.next_type = m.next_type
  where m.next is not null and m.ends = '.' and (m.is_short or m.type = '##number##')
    and not (regexp_matches(m.next, '^\\p{{Lu}}') and t.type is null and (not m.is_short or s.type is not null)))"""


@query(
    "abbreviations",
    f"with {LEARNT} select type, with_period, without_period, round(score, 6) as score from short",
)
def abbreviations(spark, sf):
    """The abbreviations of all texts, by how they come with a period."""
    short, _ = sentences.learnt(b.table(spark, sf, "documents"))
    return short.select("type", big("with_period"), big("without_period"), r6("score"))


@query(
    "learned_sentences",
    f"""with {LEARNT},
    found as (select doc_id, count(*) as n from words w semi join opened o on o.word = w.word and o.next = w.next where is_marked group by doc_id),
    sized as (select doc_id, len(list_filter(w, lambda x: regexp_matches(x, '[.!?]{CLOSERS}*\\z'))) as marks,
      case when len(w) > 0 and not regexp_matches(w[-1], '[.!?]{CLOSERS}*\\z') then 1 else 0 end as tail from texts)
    select doc_id, (marks + tail - coalesce(n, 0))::bigint as n_sentences, coalesce(n, 0)::bigint as n_open from sized left join found using (doc_id)""",
)
def learned_sentences(spark, sf):
    """Sentences of every text; periods behind abbreviations, initials and numbers are judged by what was learnt."""
    return sentences.sentence_counts(b.table(spark, sf, "documents"))
