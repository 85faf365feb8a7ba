"""Windows over events, as tables; the same functions run on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.intervals import sessions, tumbling
from .data import r6, r6_sql, read

Q: dict[str, tuple] = {
    "events_tumbling": (
        lambda s, d: tumbling(read(s, d, "events"), "1 hour", ["event_type"], [F.count("*").alias("n"), r6(F.sum("value")).alias("total")]).select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start_s"), "event_type", "n", "total"),
        f"select cast(floor(epoch(ts)/3600) as bigint)*3600 as start_s, event_type, count(*) as n, {r6_sql('sum(value)')} as total from events group by all",
    ),
    "events_sessions": (
        lambda s, d: sessions(read(s, d, "events"), "30 minutes", ["user_id"], [F.count("*").alias("n")]).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest")),
        "with a as (select user_id, ts, case when epoch(ts)-epoch(lag(ts) over (partition by user_id order by ts, event_id))<1800 then 0 else 1 end as o from events), b as (select *, sum(o) over (partition by user_id order by ts, o desc rows between unbounded preceding and current row) as k from a), c as (select user_id, k, count(*) as n from b group by all) select user_id, count(*) as sessions, max(n) as longest from c group by user_id",
    ),
}
