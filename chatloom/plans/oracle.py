"""SQL counterparts of the core queries, written independently of the DataFrame plans."""

from __future__ import annotations

from chatloom.functions import text as ft
from chatloom.functions.media import DEFAULT_EXTENSIONS, MIME_EXTENSIONS
from chatloom.schemas import CHAT_TYPES, MEDIA_SLOTS

BUCKET = "coalesce(strftime(date, '%Y-%m') || '-w' || cast((day(date) - 1) // 7 + 1 as varchar), 'unknown')"
SLOTS = ", ".join(MEDIA_SLOTS)
MEDIA = f"coalesce({SLOTS})"
CURRENT = (
    "(select id, split_part(chat_type, '.', -1) as chat_type, username, qualname, history_complete, oldest_message_id, "
    "latest_message_id, ord from chat_state qualify row_number() over (partition by id order by ord desc) = 1)"
)


def name_of(user: str) -> str:
    full = f"concat_ws(' ', nullif({user}.first_name, ''), nullif({user}.last_name, ''))"
    return f"coalesce(nullif({full}, ''), nullif({user}.username, ''), cast({user}.id as varchar))"


AUTHOR = (
    f"case when from_user is not null then {name_of('from_user')} when sender_chat is not null then "
    "coalesce(nullif(sender_chat.title, ''), nullif(sender_chat.username, ''), cast(sender_chat.id as varchar)) "
    f"else '{ft.UNKNOWN_AUTHOR}' end"
)
EVENT = (
    f"case when len(new_chat_members) > 0 then '{ft.ADDED}' || array_to_string(list_transform(new_chat_members, lambda u: {name_of('u')}), ', ') "
    f"when left_chat_member is not null then '{ft.LEFT}' || {name_of('left_chat_member')} "
    f"when nullif(new_chat_title, '') is not null then '{ft.RETITLED}' || new_chat_title "
    f"when delete_chat_photo then '{ft.PHOTO_REMOVED}' when new_chat_photo is not null then '{ft.PHOTO_CHANGED}' "
    f"when group_chat_created or supergroup_chat_created or channel_chat_created then '{ft.CREATED}' "
    f"when pinned_message is not null then '{ft.PINNED}' end"
)
BODY = f"coalesce(nullif(text, ''), nullif(caption, ''), {EVENT})"
FILE_ID = f"coalesce({MEDIA}.big_file_id, {MEDIA}.file_id)"
RECORDS = (
    f"(select chat_id, id, arrival_seq, cast(chat_id as varchar) || '/' || case when reply_to_top_message_id is null then '' "
    f"else cast(reply_to_top_message_id as varchar) || '/' end || {BUCKET} || '.txt' as path, "
    f"'[' || coalesce(strftime(date, '%Y-%m-%d %H:%M:%S'), 'unknown') || '] ' || {AUTHOR} || ': ' || "
    f"coalesce(nullif(text, ''), nullif(caption, ''), {EVENT}) || chr(10) || chr(10) as text from messages)"
)
BRIEF = (
    "select id, split_part(type, '.', -1) as chat_type, username, case split_part(type, '.', -1) when 'BOT' then first_name "
    "when 'PRIVATE' then case when nullif(last_name, '') is not null then coalesce(first_name, 'None') || ' ' || last_name else first_name end "
    "when 'CHANNEL' then title when 'GROUP' then title when 'SUPERGROUP' then title else 'unknown' end as qualname"
)
DIRECTORY = "coalesce(replace(lower(file_type || 's'), '_', ' '), 'unknown_files')"


def case_of(key: str, table: dict[str, str]) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


FILES = f"""
(select arrival_seq, raw_file_id, stem || '_' || coalesce(u, 'None') || '.' || ext as file_name, file_size, file_type from (
 select *, case when contains(n, '.') then regexp_replace(n, '\\.[^.]*$', '') else n end as stem,
  case when contains(n, '.') then split_part(n, '.', -1) else 'unknown' end as ext from (
  select arrival_seq, coalesce(m.big_file_id, m.file_id) as raw_file_id, m.file_size as file_size, upper(m.kind) as file_type,
   m.file_unique_id as u, case when lower(m.kind) = 'sticker' then 'sticker_' || coalesce(m.set_name, 'None') || '_' || coalesce(m.emoji, 'None') || '_' || coalesce(m.file_unique_id, 'None') || '.webp'
   else coalesce(nullif(m.file_name, ''), lower(m.kind) || '_' || coalesce(strftime(m.date, '%Y-%m-%d %H:%M:%S'), '2026-01-01_00-00-00') || '.' ||
    coalesce({case_of('m.mime_type', MIME_EXTENSIONS)}, {case_of('upper(m.kind)', DEFAULT_EXTENSIONS)}, '.unknown')) end as n
  from (select arrival_seq, {MEDIA} as m from messages) where m is not null and coalesce(m.big_file_id, m.file_id) is not null)))
"""
TOPIC_FIRST = "(select chat_id, topic_id, min(title) as title from topics group by 1, 2)"
TOPIC_RENAMED = "(select chat_id, topic_id, max(title) as title from topics group by 1, 2 having count(distinct title) > 1)"
CHUNKS = (
    "(select *, (row_number() over (partition by chat_id order by id desc, arrival_seq) - 1) // {n} as batch_no from messages)"
)
FIRSTS = (
    "select chat_id, id, arrival_seq, batch_id, date, text, caption from messages "
    "qualify row_number() over (partition by chat_id, id order by arrival_seq) = 1"
)


def human_size() -> str:
    steps = []
    for power, prefix in ((6, "E"), (5, "P"), (4, "T"), (3, "G"), (2, "M"), (1, "k")):
        scaled = f"cast((cast(file_size as hugeint) * 100 + {1000**power // 2}) // {1000**power} as hugeint)"
        steps.append(f"when file_size > {1000**power} then cast({scaled} // 100 as varchar) || '.' || lpad(cast({scaled} % 100 as varchar), 2, '0') || ' {prefix}B'")
    steps.append("when file_size > 0 then cast(file_size as varchar) || '.00 B'")
    steps.append("when file_size = 0 then '0.00 qB'")
    return "case " + " ".join(steps) + " end"


def oracle_sql() -> dict[str, str]:
    marks = f"{CURRENT} s on s.id = m.chat_id"
    return {
        "bucket_rollup": f"select chat_id, reply_to_top_message_id as thread_id, {BUCKET} as bucket, count(*) as n_messages, count({MEDIA}) as n_media, min(id) as min_id, max(id) as max_id from messages group by all",
        "week_bucket_counts": f"select {BUCKET} as bucket, count(*) as n_messages from messages group by 1",
        "state_merge": f"select c.*, coalesce(s.history_complete, false) as history_complete, s.oldest_message_id, s.latest_message_id from ({BRIEF} from (select distinct * from chats)) c left join {CURRENT} s using (id)",
        "current_state": f"select * from {CURRENT}",
        "ensure_chat_state": f"""with saved as (select id, (select chat_type from chat_state x where x.id = s.id and x.ord = s.ord) as chat_type, username, qualname, history_complete, oldest_message_id, latest_message_id from {CURRENT} s where history_complete)
            select * from saved union all ({BRIEF}, false, null, null from (select id, max(type) as type, max(title) as title, max(username) as username, max(first_name) as first_name, max(last_name) as last_name from chats group by id) c where not exists (select 1 from saved where saved.id = c.id))""",
        "chat_brief": f"{BRIEF} from chats",
        "chat_mapping_dedup": f"select id, qualname from {CURRENT}",
        "chat_mapping_lines": "select ord, cast(id as varchar) || chr(9) || coalesce(qualname, 'None') as line from chat_state",
        "dense_chat_type_counts": f"select t.chat_type, count(c.id) as n_chats from (select unnest({list(CHAT_TYPES)}) as chat_type) t left join chats c on split_part(c.type, '.', -1) = t.chat_type group by 1",
        "chat_progress": "select chat_id, min(id) as oldest_message_id, max(id) as latest_message_id, count(*) as n_messages from messages group by 1",
        "running_state": "select chat_id, id, arrival_seq, min(id) over w as oldest_message_id, max(id) over w as latest_message_id from messages window w as (partition by chat_id order by arrival_seq rows unbounded preceding)",
        "state_validation": "select id, chat_type, cast(null as varchar) as username, coalesce(qualname, '') as qualname, case when ord % 8 = 4 then false else history_complete end as history_complete, oldest_message_id, latest_message_id from chat_state where ord % 8 in (0, 4) and history_complete is not null and chat_type is not null",
        "tail_incremental": f"select m.chat_id, m.id, m.arrival_seq from messages m join {marks} where m.id > s.latest_message_id",
        "backfill_resume": f"select m.chat_id, m.id, m.arrival_seq from messages m join {marks} where coalesce((s.oldest_message_id + s.latest_message_id) // 2, 0) = 0 or m.id < (s.oldest_message_id + s.latest_message_id) // 2",
        "backfill_batches": f"select chat_id, batch_no, count(*) as n_rows, min(id) as oldest_message_id, max(id) as latest_message_id from {CHUNKS.format(n=10)} group by 1, 2",
        "batch_counter": f"select chat_id, batch_no, cast(sum(count(*)) over (partition by chat_id order by batch_no) as bigint) as counter from {CHUNKS.format(n=1000)} group by 1, 2",
        "sync_state": f"""with s as (select * from {CURRENT}), r as (select s.id, min(m.id) as low, max(m.id) as high from s join messages m on m.chat_id = s.id
            where case when s.history_complete then m.id > s.latest_message_id else coalesce(s.oldest_message_id, 0) = 0 or m.id < s.oldest_message_id end group by 1)
            select s.id, true as history_complete, case when s.history_complete then s.oldest_message_id else coalesce(r.low, s.oldest_message_id) end as oldest_message_id,
            case when s.history_complete then greatest(s.latest_message_id, r.high) else coalesce(s.latest_message_id, r.high) end as latest_message_id from s left join r using (id)""",
        "live_high_water": "select chat_id, id, arrival_seq from (select *, max(id) over (partition by chat_id order by arrival_seq rows between unbounded preceding and 1 preceding) as seen from messages) where seen is null or id > seen",
        "live_stream": "select chat_id, id, arrival_seq from (select *, max(id) over (partition by chat_id order by arrival_seq rows between unbounded preceding and 1 preceding) as seen from messages where chat_id is not null and id is not null) where seen is null or id > seen",
        "sync_job": f"""with c as (select distinct id from chats), h as (select * from messages where batch_id in (select batch_id from export_batches where phase = 'backfill' and committed)),
            one as (select c.id, min(h.id) as low, max(h.id) as high from c left join h on h.chat_id = c.id group by 1),
            rows_ as (select h.*, 1 as run from h union all by name select m.*, 2 as run from messages m join one on one.id = m.chat_id and m.id > one.high),
            n as (select chat_id, max(id) filter (run = 2) as top, count(*) as n_messages, count({FILE_ID}) as n_medias, count({BODY}) as n_texts from rows_ group by 1)
            select one.id, true as history_complete, one.low as oldest_message_id, greatest(one.high, n.top) as latest_message_id, coalesce(n_messages, 0) as n_messages, coalesce(n_medias, 0) as n_medias, coalesce(n_texts, 0) as n_texts
            from one left join n on n.chat_id = one.id""",
        "live_append": f"""with a as (select * from (select *, max(id) over (partition by chat_id order by arrival_seq rows between unbounded preceding and 1 preceding) as seen from messages where chat_id is not null and id is not null) where seen is null or id > seen),
            t as (select chat_id, count(*) as n from (select distinct chat_id, topic_id from topics) p where exists (select 1 from a where a.chat_id = p.chat_id and a.reply_to_top_message_id = p.topic_id) group by 1)
            select a.chat_id as id, false as history_complete, min(id) as oldest_message_id, max(id) as latest_message_id, count(*) as n_messages, count({FILE_ID}) as n_medias, count({BODY}) as n_texts, coalesce(any_value(t.n), 0) as n_topics
            from a left join t on t.chat_id = a.chat_id group by 1""",
        "manifest_scan": "select raw_file_id, file_name, file_size, file_type from media_manifest where raw_file_id is not null",
        "topic_paging": """with p as (select chat_id, topic_id, max(title) as title from topics group by 1, 2), q as (select *, row_number() over (partition by chat_id order by topic_id desc) as place from p),
            v as (select *, place - coalesce(lag(place) over (partition by chat_id order by place), 0) as gap from q where regexp_matches(title, '[^\\s\\p{Z}]'))
            select chat_id, topic_id, title from v where not exists (select 1 from v w where w.chat_id = v.chat_id and w.place <= v.place and w.gap > 2)""",
        "topic_titles": "select chat_id, topic_id, trim(regexp_replace(title, '[\\s\\p{Z}]+', ' ', 'g')) as title from topics",
        "topic_upsert": f"select * from {TOPIC_RENAMED} union all select o.* from {TOPIC_FIRST} o where not exists (select 1 from {TOPIC_RENAMED} n where n.chat_id = o.chat_id and n.topic_id = o.topic_id)",
        "topic_replace": f"with fresh as (select chat_id, topic_id, max(title) as title from topics where chat_id in (select chat_id from {TOPIC_RENAMED}) group by 1, 2) select * from fresh union all select o.* from {TOPIC_FIRST} o where o.chat_id not in (select chat_id from fresh)",
        "topic_exists": "select chat_id, id, reply_to_top_message_id, arrival_seq from messages m where exists (select 1 from topics t where t.chat_id = m.chat_id and t.topic_id = m.reply_to_top_message_id)",
        "topic_unknown": "select distinct chat_id, reply_to_top_message_id from messages m where reply_to_top_message_id is not null and not exists (select 1 from topics t where t.chat_id = m.chat_id and t.topic_id = m.reply_to_top_message_id)",
        "keyset_page": "select chat_id, topic_id, max(title) as title from topics group by 1, 2 having topic_id < 40 or (topic_id = 40 and chat_id < 0) order by topic_id desc, chat_id desc limit 100",
        "forum_chats": f"select id, coalesce(chat_type = 'SUPERGROUP' and id in (select chat_id from topics), false) as is_forum from {CURRENT}",
        "topic_lookup": "select chat_id, topic_id, title from topics where topic_id in (3, 8, 11, 13, 24)",
        "chat_avatars": "select chat_id, count(*) as n_photos, string_agg(new_chat_photo.file_unique_id, ',' order by id, arrival_seq) as photos from messages where new_chat_photo is not null group by 1",
        "media_queue": "select chat_id, count(*) as n_files, cast(sum(file_size) as bigint) as total_bytes from media_manifest where raw_file_id is not null group by 1",
        "message_media_split": f"select chat_id, count(*) as n_messages, count({MEDIA}) as n_medias from messages group by 1",
        "topic_lines": "select chat_id, topic_id, title || chr(9) || 'end' as title from topics where topic_id % 5 > 1",
        "topics_fallback": "select chat_id, k as topic_id, case k % 3 when 0 then 'json' else 'text' end as title from (select chat_id, min(topic_id) as k from topics group by 1) where k % 3 < 2",
        "event_text_case": f"select chat_id, id, arrival_seq, {EVENT} as event from messages where {EVENT} is not null",
        "author_label": f"select arrival_seq, {AUTHOR} as author from messages",
        "text_render": f"select * from {RECORDS} where text is not null",
        "text_concat": f"select path, string_agg(text, '' order by arrival_seq) as text, count(*) as n_records from {RECORDS} where text is not null group by 1",
        "media_coalesce": f"select arrival_seq, m.kind as kind, m.file_unique_id as file_unique_id from (select arrival_seq, {MEDIA} as m from messages) where m is not null",
        "media_filename": f"select *, {DIRECTORY} as directory, replace(file_name, ':', '-') as disk_name from {FILES}",
        "media_directories": f"select {DIRECTORY} as directory, count(*) as n_files, cast(sum(file_size) as bigint) as total_bytes from media_manifest group by 1",
        "skip_existing": f"""with f as (select chat_id, message_id, {DIRECTORY} as directory, replace(file_name, ':', '-') as disk_name from media_manifest where raw_file_id is not null)
            select chat_id, min(message_id) as message_id, directory, disk_name from f where not exists (select 1 from f e where e.message_id % 4 = 0 and e.chat_id = f.chat_id and e.directory = f.directory and e.disk_name = f.disk_name) group by chat_id, directory, disk_name""",
        "human_readable_size": f"select distinct file_size, {human_size()} as shown from media_manifest",
        "json_props": "select event_type, cast(props ->> '$.k' as int) as k, count(*) as n from events group by 1, 2",
        "tagged_load": "select raw_id, payload ->> '$._' as tag, cast(payload ->> '$.id' as bigint) as id, payload ->> '$.date' as date from raw_messages where json_valid(payload) and payload ->> '$._' = 'Message'",
        "paged_history": "select chat_id, count(*) as n, max(id) as latest_message_id from messages group by 1",
        "media_slots_used": " union all ".join(f"select '{s}' as slot, count({s}) as n_messages from messages" for s in MEDIA_SLOTS),
        "p4_found": """with n as (select raw_id, t.path as node_path from raw_messages r, json_tree(r.payload) t where json_valid(r.payload) and t.key = '_')
            select n.raw_id, n.node_path, max_by(p.node_path, length(p.node_path)) as parent_path from n left join n p on p.raw_id = n.raw_id
            and (starts_with(n.node_path, p.node_path || '.') or starts_with(n.node_path, p.node_path || '[')) where n.node_path <> '$' group by 1, 2""",
        "p4_paths": """with n as (select raw_id, t.path as node_path, t.atom as tag from raw_messages r, json_tree(r.payload) t where json_valid(r.payload) and t.key = '_')
            select n.raw_id, n.node_path, max_by(p.node_path, length(p.node_path)) as parent_path, regexp_replace(n.node_path, '\\[\\d+\\]', '[]', 'g') as schema_path,
            any_value(case when json_type(n.tag) = 'VARCHAR' then n.tag ->> '$' end) as kind from n left join n p on p.raw_id = n.raw_id
            and (starts_with(n.node_path, p.node_path || '.') or starts_with(n.node_path, p.node_path || '[')) group by 1, 2""",
        "p4_users": """with n as (select raw_id, payload, t.path as node_path, t.atom as tag from raw_messages r, json_tree(r.payload) t where json_valid(r.payload) and t.key = '_')
            select n.raw_id, n.node_path, max_by(p.node_path, length(p.node_path)) as parent_path, any_value(json_extract_string(n.payload, n.node_path || '.id')) as id,
            any_value(json_extract_string(n.payload, n.node_path || '.first_name')) as first_name from n left join n p on p.raw_id = n.raw_id
            and (starts_with(n.node_path, p.node_path || '.') or starts_with(n.node_path, p.node_path || '[')) where n.tag = '"User"' group by 1, 2""",
        "p5_found": "select chat_id, id, arrival_seq from messages where chat_id is not null and id is not null qualify row_number() over (partition by chat_id, id order by arrival_seq) > 1",
        "p5_messages": FIRSTS,
    }
