"""Text features, similarity and response analysis over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import bindings as b
from checks import sql as s
from checks.registry import big, joined, query, r6
from markbook.config import DEFAULT
from markbook.functions import similarity as sim
from markbook.functions import text as tx
from markbook.operators import scoring


@query(
    "clean_text",
    r"""select doc_id, trim(regexp_replace(regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'),
          '[^\p{L}\p{N}_\s.,!?;:()\-]', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) as cleaned from documents""",
)
def clean_text(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


CONTRACTED = "replace(replace(text, ' the ', ' they''re don''t '), ' is ', ' isn''t it''s ')"


@query(
    "word_tokens",
    f"""select doc_id, len(t)::bigint as n, array_to_string(t, ' ') as tokens
        from (select doc_id, {s.tokens(CONTRACTED)} as t from documents)""",
)
def word_tokens(spark, sf):
    text = F.replace(F.col("text"), F.lit(" the "), F.lit(" they're don't "))
    text = F.replace(text, F.lit(" is "), F.lit(" isn't it's "))
    d = b.table(spark, sf, "documents").select("doc_id", tx.word_tokens(text).alias("t"))
    return d.select("doc_id", big(F.size("t"), "n"), F.array_join("t", " ").alias("tokens"))


@query("sentence_count", f"select doc_id, {s.sentences('text')}::bigint as sentences from documents")
def sentence_count(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", big(tx.sentence_count(F.col("text")), "sentences"))


@query(
    "word_syllables",
    f"""select word, {s.syllables('word')}::bigint as syllables, count(*) as n
        from (select lower(unnest({s.tokens('text')})) as word from documents) group by word""",
)
def word_syllables(spark, sf):
    words = b.table(spark, sf, "documents").select(F.explode(tx.word_tokens(F.col("text"))).alias("word"))
    counted = words.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    return counted.select("word", big(tx.count_syllables(F.col("word")), "syllables"), "n")


def _measured(spark, sf):
    d = tx.with_metrics(b.table(spark, sf, "documents").select("doc_id", "lang", "text"), F.col("text"), "q")
    m = tx.metrics_of("q")
    return d.withColumn("grade", tx.readability(m)), m


MEASURED = f"m as ({s.metrics('text', 'q', 'documents', 'doc_id, lang, text')})"


@query(
    "readability",
    f"""with {MEASURED} select doc_id, q_words::bigint as words, q_sentences::bigint as sentences,
        q_syllables as syllables, round(q_grade, 6) as grade from m""",
)
def readability(spark, sf):
    d, m = _measured(spark, sf)
    return d.select(
        "doc_id", big(m.words, "words"), big(m.sentences, "sentences"), big(m.syllables, "syllables"), r6("grade")
    )


@query(
    "age_check",
    f"""with {MEASURED} select doc_id, round(q_average, 6) as average, q_ok as ok,
        array_to_string({s.advice('q')}, ' | ') as advice from m""",
)
def age_check(spark, sf):
    d, m = _measured(spark, sf)
    c = F.col("c")
    return d.withColumn("c", tx.age_check(F.col("grade"), m)).select(
        "doc_id",
        r6(c["avg_sentence_length"], "average"),
        c["is_appropriate"].alias("ok"),
        joined(c["recommendations"], "advice"),
    )


@query(
    "reading_level_by_language",
    f"""with {MEASURED} select lang, count(*) as texts, round(avg(q_grade), 6) as mean_grade,
        round(avg(q_ok::int::double), 6) as share_appropriate, sum(q_words)::bigint as words from m group by lang""",
)
def reading_level_by_language(spark, sf):
    d, m = _measured(spark, sf)
    ok = tx.is_age_appropriate(F.col("grade"), tx.average_sentence_length(m), m.words)
    return (
        d.withColumn("ok", ok)
        .groupBy("lang")
        .agg(
            F.count("*").alias("texts"),
            r6(F.avg("grade"), "mean_grade"),
            r6(F.avg(F.col("ok").cast("double")), "share_appropriate"),
            F.sum(m.words).alias("words"),
        )
    )


@query(
    "content_words",
    f"select doc_id, {s.content_words('text')} as words from documents",
)
def content_words(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", sim.content_words(F.col("text")).alias("words"))


@query("normalized_text")
def normalized_text(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", sim.normalize(F.col("text")).alias("normalized"))


def _pairs(spark, sf):
    return b.dialogue(spark, sf).withColumn("response", F.coalesce("response", F.lit("")))


@query(
    "pair_cosine",
    f"""with {b.DIALOGUE_SQL},
    w as (select conv_id, turn, {s.vector_terms("coalesce(response, '')")} as a, {s.vector_terms('question_text')} as b from dialogue),
    t as (
      select conv_id, turn, unnest(a) as term, 1 as x, 0 as y from w
      union all select conv_id, turn, unnest([a[i] || ' ' || a[i + 1] for i in range(1, len(a))]), 1, 0 from w
      union all select conv_id, turn, unnest(b), 0, 1 from w
      union all select conv_id, turn, unnest([b[i] || ' ' || b[i + 1] for i in range(1, len(b))]), 0, 1 from w),
    c as (select conv_id, turn, term, sum(x)::double as x, sum(y)::double as y from t group by all),
    k as (select * from c qualify row_number() over (partition by conv_id, turn order by x + y desc, term) <= {DEFAULT.vectorizer_features}),
    v as (select conv_id, turn, case when x > 0 and y > 0 then 1::double else ln(1.5::double) + 1 end as i, x, y from k),
    n as (select conv_id, turn, sum(x * i * y * i) as dot, sum((x * i) ** 2) as xx, sum((y * i) ** 2) as yy from v group by all)
    select conv_id, turn, round(case when n.dot is null then null when xx > 0 and yy > 0 then dot / (sqrt(xx) * sqrt(yy)) else 0::double end, 6) as cosine
    from dialogue left join n using (conv_id, turn)""",
)
def pair_cosine(spark, sf):
    return _pairs(spark, sf).select(
        "conv_id", "turn", r6(sim.cosine(F.col("response"), F.col("question_text")), "cosine")
    )


@query("string_ratio")
def string_ratio(spark, sf):
    return _pairs(spark, sf).select(
        "conv_id", "turn", r6(sim.string_ratio(F.col("response"), F.col("question_text")), "ratio")
    )


@query("answer_similarity")
def answer_similarity(spark, sf):
    return _pairs(spark, sf).select(
        "conv_id", "turn", r6(sim.similarity(F.col("response"), F.col("question_text")), "similarity")
    )


ANALYSIS = f"{b.DIALOGUE_SQL}, a as ({s.analysis('dialogue', 'conv_id, turn')})"


def _analysed(spark, sf):
    pairs = _pairs(spark, sf).withColumns(
        {
            "lowered": F.lower("response"),
            "concepts": tx.question_concepts(F.col("question_text"), DEFAULT.stop_words),
        }
    )
    d = tx.with_metrics(pairs, F.col("response"), "r")
    relevant = tx.is_relevant(F.col("concepts"), F.col("lowered"))
    return d.withColumn("relevant", relevant).withColumn(
        "analysis",
        scoring.response_analysis(
            F.col("response"), F.col("lowered"), tx.metrics_of("r"), F.col("relevant")
        ),
    )


@query(
    "organization_score",
    f"""select doc_id, round({s.organization('text', s.sentences('text'))}, 6) as organization from documents""",
)
def organization_score(spark, sf):
    return b.table(spark, sf, "documents").select(
        "doc_id", r6(tx.organization_score(F.lower(F.col("text")), tx.sentence_count(F.col("text"))), "organization")
    )


@query(
    "language_quality",
    f"""with {MEASURED} select doc_id, round({s.language_quality('text', 'q_words', 'q_sentences')}, 6) as quality from m""",
)
def language_quality(spark, sf):
    d, m = _measured(spark, sf)
    return d.select("doc_id", r6(tx.language_quality(F.col("text"), m), "quality"))


@query(
    "content_relevance",
    f"""with {b.DIALOGUE_SQL},
    c as (select conv_id, turn, {s.concepts('question_text')} as concepts, lower(coalesce(response, '')) as r from dialogue),
    h as (select *, len([x for x in concepts if contains(r, x)]) as hits from c)
    select conv_id, turn, len(concepts)::bigint as concepts, hits::bigint as hits,
      hits >= greatest(1::double, len(concepts) * 0.3::double) as relevant from h""",
)
def content_relevance(spark, sf):
    d = _pairs(spark, sf).withColumns(
        {
            "low": F.lower("response"),
            "c": tx.question_concepts(F.col("question_text"), DEFAULT.stop_words),
        }
    )
    return d.select(
        "conv_id",
        "turn",
        big(F.size("c"), "concepts"),
        big(tx.concept_hits(F.col("c"), F.col("low")), "hits"),
        tx.is_relevant(F.col("c"), F.col("low")).alias("relevant"),
    )


@query(
    "response_analysis",
    f"""with {ANALYSIS} select conv_id, turn, word_count::bigint as word_count, sentence_count::bigint as sentence_count,
      has_content, round(organization_score, 6) as organization_score, round(content_score, 6) as content_score,
      round(language_quality, 6) as language_quality from a""",
)
def response_analysis(spark, sf):
    a = F.col("analysis")
    return _analysed(spark, sf).select(
        "conv_id",
        "turn",
        big(a["word_count"], "word_count"),
        big(a["sentence_count"], "sentence_count"),
        a["has_content"].alias("has_content"),
        r6(a["organization_score"], "organization_score"),
        r6(a["content_score"], "content_score"),
        r6(a["language_quality"], "language_quality"),
    )


@query(
    "complexity_indicators",
    f"select doc_id, {s.indicators('lower(text)')} from documents",
)
def complexity_indicators(spark, sf):
    d = b.table(spark, sf, "documents").select("doc_id", F.lower(F.col("text")).alias("low"))
    return d.select("doc_id", *[c.alias(n) for n, c in tx.complexity_indicators(F.col("low")).items()])


@query(
    "topic_score",
    f"""with {MEASURED} select doc_id, round({s.topic_score('lower(text)', 'q_ok')}, 6) as score from m""",
)
def topic_score(spark, sf):
    d, m = _measured(spark, sf)
    ok = tx.is_age_appropriate(F.col("grade"), tx.average_sentence_length(m), m.words)
    d = d.withColumns({"ok": ok, "low": F.lower(F.col("text"))})
    return d.select(
        "doc_id",
        r6(tx.topic_score(F.col("low"), tx.appropriate_when_lowered(F.col("text"), F.col("ok"))), "score"),
    )
