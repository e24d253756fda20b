"""Queries over the table directory for the operators on training text, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chatloom.llm import conversations, langid, leakage, lookalikes, moderation, packing, pii
from chatloom.sources.files import table
from chatloom.storage import written


def _chat_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "messages"), table(spark, d, "chat_state"), table(spark, d, "bot_accounts")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.dropped(*_chat_inputs(spark, d)).select("chat_id", "thread_id")


def p1_conversations(spark: SparkSession, d: str) -> DataFrame:
    rows = conversations.rebuild(*_chat_inputs(spark, d))
    return rows.select("chat_id", "thread_id", "turn", "id", "role", "body")


def p1_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = conversations.turns(written(conversations.kept_rows(*_chat_inputs(spark, d)), "kept"))
    return rows.select("chat_id", "thread_id", "turn", "id", "role", "session")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_looking(lookalikes.names_of(table(spark, d, "chat_state")))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.with_canonical(lookalikes.names_of(table(spark, d, "chat_state")), "value", "form")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.classes(lookalikes.names_of(table(spark, d, "chat_state")))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "text_records")
    return langid.label_sentences(records, "record_id", "text", langid.fit(records, "record_id", "text", "lang"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    languages = langid.document_languages(_sentences(spark, d), "record_id")
    return langid.missing_or_wrong(table(spark, d, "text_records"), "record_id", "lang", languages)


def p3_stretches(spark: SparkSession, d: str) -> DataFrame:
    return langid.stretches(_sentences(spark, d), "record_id")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return langid.record_languages(table(spark, d, "text_records"), _sentences(spark, d), "record_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "text_records"), "record_id", "text").select("record_id", "line_no", "kind").distinct()


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "text_records"), "record_id", "text")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", "text")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(table(spark, d, "documents"), "doc_id", "text"))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    return packing.invariants(packing.pack(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    spans = leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")
    return spans.select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return moderation.score(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "moderation_labels"), ("source",))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return moderation.flagged(_scored(spark, d), "doc_id").select("doc_id", "category")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return moderation.rates(_scored(spark, d), "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        p1_found, p1_conversations, p1_sessions, p2_found, p2_forms, p2_classes, p3_found, p3_stretches, p3_records, p6_found, p6_redacted,
        p7_packed, p7_fill, p7_invariants, p8_found, p8_spans,
        p9_found, p9_scores, p9_rates,
    )
    return {f.__name__: f for f in named}


VISIBLE = r"[^\s\p{Z}\p{Cc}\p{Cf}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}\x{034F}\x{FE00}-\x{FE0F}]"
COUNTED = f"""
firsts as (select * from messages where chat_id is not null and id is not null qualify row_number() over (partition by chat_id, id order by arrival_seq) = 1),
marks as (select id, latest_message_id as mark from chat_state qualify row_number() over (partition by id order by ord desc) = 1),
counted as (select m.chat_id, m.id, m.reply_to_top_message_id as thread_id,
  case when m.from_user is null then 'system' when m.from_user.id in (select id from bot_accounts) then 'assistant' else 'user' end as role,
  m.date as sent, case when regexp_matches(coalesce(nullif(m.text, ''), m.caption), '{VISIBLE}') then coalesce(nullif(m.text, ''), m.caption) end as body
  from firsts m left join marks k on k.id = m.chat_id where k.mark is null or m.id <= k.mark),
threads as (select distinct chat_id, thread_id from counted where thread_id is not null),
members as (select t.chat_id, t.thread_id, c.id, c.role, c.body, c.sent from threads t join counted c on c.chat_id = t.chat_id and (c.thread_id = t.thread_id or c.id = t.thread_id)),
judged as (select chat_id, thread_id, bool_or(id = thread_id) as opened, max(case when role = 'user' and body is not null then id end) as asked,
  max(case when role = 'assistant' and body is not null then id end) as answered from members group by 1, 2),
lost as (select chat_id, thread_id from judged where not opened or asked is null or answered is null or answered < asked)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def same_looking_sql() -> str:
    """Names by a form that replaces each character by the first of its class; full-width forms stand for all
    compatibility forms, which is enough for names without ligatures and the like."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    first = {ord(c): g[0] for g in lookalikes.LOOKALIKES for c in g}
    source = "".join(c for g in lookalikes.LOOKALIKES for c in g[1:]) + wide + lookalikes.HYPHENS + lookalikes.APOSTROPHES
    target = "".join(g[0] for g in lookalikes.LOOKALIKES for _ in g[1:]) + "".join(map(chr, range(0x21, 0x7F))).translate(first)
    target += "-" * len(lookalikes.HYPHENS) + "'" * len(lookalikes.APOSTROPHES)
    ignorable = "[\\p{Cf}" + "".join(f"\\x{{{ord(c):04X}}}" for c in lookalikes.IGNORABLE) + "]"
    form = f"translate(nfc_normalize(regexp_replace(value, '{ignorable}', '', 'g')), {_quoted(source)}, {_quoted(target)})"
    return f"""with s as (select id, qualname, username from chat_state qualify row_number() over (partition by id order by ord desc) = 1),
        n as (select id, field, value from s unpivot (value for field in (qualname, username)) where value <> '' and id is not null),
        k as (select *, trim(regexp_replace({form}, '[\\s\\p{{Z}}]+', ' ', 'g')) as form from n)
        select a.id as id_a, b.id as id_b, a.field from k a join k b on a.field = b.field and a.form = b.form and a.id < b.id and a.value <> b.value"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": same_looking_sql(),
        "p7_invariants": "select count(*) as n_docs, cast(0 as bigint) as n_gaps, cast(0 as bigint) as n_overfull, cast(0 as bigint) as n_divided_without_need from documents where text is not null",
        "p1_found": f"with {COUNTED} select * from lost",
        "p1_conversations": f"""with {COUNTED} select chat_id, thread_id, row_number() over (partition by chat_id, thread_id order by id) - 1 as turn, id, role, body
            from members m where not exists (select 1 from lost l where l.chat_id = m.chat_id and l.thread_id = m.thread_id)""",
        "p1_sessions": f"""with {COUNTED}, paused as (select *, (epoch_us(sent) - lag(epoch_us(sent)) over (partition by chat_id, thread_id order by sent, id)) as pause from members where sent is not null),
            ranked as (select pause // 60000000 as minute, row_number() over (order by pause) as place, count(*) over () as n from paused where pause is not null),
            gap as (select greatest(1800, coalesce(max(minute * 60), 0)) as s from ranked where place = (95 * n + 99) // 100),
            numbered as (select chat_id, thread_id, id, cast(sum(case when pause > (select s from gap) * 1000000 then 1 else 0 end) over (partition by chat_id, thread_id order by sent, id rows unbounded preceding) as bigint) as session from paused)
            select m.chat_id, m.thread_id, row_number() over (partition by m.chat_id, m.thread_id order by m.id) - 1 as turn, m.id, m.role, n.session
            from members m left join numbered n on n.chat_id = m.chat_id and n.thread_id = m.thread_id and n.id = m.id
            where not exists (select 1 from lost l where l.chat_id = m.chat_id and l.thread_id = m.thread_id)""",
    }
