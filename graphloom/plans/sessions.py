"""Queries of sessions, extractor runs and prompts' keywords, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import vocabulary as V
from graphloom.functions.text import keywords
from graphloom.operators import replay, runner
from graphloom.plans import projection as P
from graphloom.plans.catalogue import query
from graphloom.streaming.sessions import session_entries

# ---- sessions


@query("""with e as (select event_id as seq, ts, user_id || ':' || strftime(ts, '%Y-%m-%d') as session_id, case when user_id % 4 = 0 then 'default' else 'agent-' || (user_id % 5) end as agent,
  case event_type when 'purchase' then 'task_complete' when 'signup' then 'shutdown' else event_type end as kind, case when event_type = 'purchase' and value < 20 or event_type = 'signup' and value < 40 then '' else 'worth ' || round(value)::bigint end as text from events),
f as (select session_id, min(struct_pack(ts := ts, seq := seq, agent := agent, text := text)) filter (kind = 'task_complete') as d, min(struct_pack(ts := ts, seq := seq, agent := agent, text := text)) filter (kind = 'shutdown') as s from e group by 1),
g as (select *, d is not null and (s is null or d.ts < s.ts or d.ts = s.ts and d.seq <= s.seq) as complete from f)
select session_id, case when complete then d.ts else s.ts end as ts, case when complete then d.agent else s.agent end as agent, case when complete then 'action' else 'handover' end as type,
  case when complete then d.text else 'Session ended (' || case when s.text = '' then 'routine' else s.text end || ')' end as summary, case when complete then 'auto-task-complete' else 'auto-session-end' end as tags
from g where (complete or s is not null) and not (complete and d.text = '')""")
def session_log(spark, d):
    """A session a user and day: purchases complete it, signups end it, some of either say nothing."""
    kind = F.when(F.col("event_type") == "purchase", "task_complete").when(F.col("event_type") == "signup", "shutdown").otherwise(F.col("event_type"))
    silent = F.expr("event_type = 'purchase' and value < 20 or event_type = 'signup' and value < 40")
    e = P.read(spark, d, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit(":"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"), F.when(F.col("user_id") % 4 == 0, "").otherwise(F.concat(F.lit("agent-"), (F.col("user_id") % 5).cast("string"))).alias("agent"),
        F.when(silent, "").otherwise(F.concat(F.lit("worth "), F.round("value").cast("long").cast("string"))).alias("text"))
    return session_entries(e)


# ---- extractor runs


def _answer(text: str) -> str:
    if "root cause" in text:
        raise ValueError("no answer")
    if "workaround" in text:
        return "nothing comes to mind"
    found = '{"entities": [{"name": "n%d"}]}' % text.count("\n\n---\n\n")
    return f"Here:\n```json\n{found}\n```" if "decision" in text else f"so {found} it is"


@query("""select agent, chunk, case when contains(t, 'root cause') then 'no answer' when contains(t, 'workaround') then 'no JSON in output' end as error,
  case when not contains(t, 'root cause') and not contains(t, 'workaround') then '{"entities": [{"name": "n' || (n - 1) || '"}]}' end as json
from (select agent, (rn - 1) // 3 as chunk, count(*) as n, string_agg(full_text, chr(10)) as t from (select *, row_number() over (partition by agent order by ts, seq) as rn from log) group by 1, 2)""")
def extractor_runs(spark, d):
    """A call for each chunk of the log: some answer, fenced or not, some raise, some say nothing of use."""
    chunks = replay.chunks(P.log(spark, d), 3)
    return runner.extract(chunks, _answer).select("agent", "chunk", "error", "json")


# ---- prompts


_STOP = ", ".join(f"'{w}'" for w in V.STOP_WORDS)


@query(f"select conv_id, turn, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^A-Za-z0-9_-]', ' ', 'g'), ' +'), lambda w: length(w) > 2 and w not in ({_STOP}))[1:8], ' ') as keywords from conversations where role = 'user'")
def prompt_keywords(spark, d):
    """What users' turns are looked up by."""
    t = P.read(spark, d, "conversations").filter("role = 'user'")
    return t.select("conv_id", "turn", F.array_join(keywords(F.col("text")), " ").alias("keywords"))
