"""Edges that no call shows: events, requests, messages, dispatch by name, and routes of web frameworks, by expressions over sources.

Emitters and listeners of one channel are never listed as pairs: a channel comes out with its counts and, in ``channel_members``, its members.
A few sample sources are added to the table's, so that every family has a member.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.plans.relational import S, files, symbols

QUOTED = "\\s*[\"'`]([^\"'`]+)[\"'`]"
#: Family, role (out: emits, in: listens), ending of the path, and the expression whose first group is the channel.
FAMILIES = [
    ("event", "out", "", r"\b(?:emit|emit_all|publish|trigger)\s*\(" + QUOTED), ("event", "out", "", r"\$emit\s*\(" + QUOTED), ("event", "in", "", r"\b(?:on|once|listen|addEventListener|subscribe)\s*\(" + QUOTED),
    ("message", "out", "", r"\brequest\s*\(" + QUOTED), ("message", "out", "", r"\bsend\s*\(\s*JSON\.stringify\s*\(\s*\{[^}]*method\s*:" + QUOTED), ("message", "in", "", r"\bcase" + QUOTED.replace("\\s*[", "\\s+[", 1) + r"\s*:"),
    ("channel", "out", ".go", r"([A-Za-z_]\w*)\s*<-\s*[\w\"]"), ("channel", "in", ".go", r"(?:=|return|case|\()\s*<-\s*([A-Za-z_]\w*)"), ("stream", "out", ".rs", r"([A-Za-z_]\w*)\s*\.\s*send\s*\("), ("stream", "in", ".rs", r"([A-Za-z_]\w*)\s*\.\s*recv(?:_async)?\s*\("),
    ("signal", "out", ".py", r"([A-Za-z_]\w*)\s*\.\s*send\s*\(\s*sender\s*="), ("signal", "in", ".py", r"([A-Za-z_]\w*)\s*\.\s*connect\s*\(\s*[A-Za-z_]"), ("signal", "in", ".py", r"@receiver\s*\(\s*([A-Za-z_]\w*)"),
    ("delegate", "out", ".cs", r"([A-Za-z_]\w*)\s*\?\.\s*Invoke\s*\("), ("delegate", "in", ".cs", r"([A-Za-z_]\w*)\s*\+=\s*[A-Za-z_][\w.]*\s*;"), ("command", "out", ".ts", r"\binvoke\s*\(" + QUOTED), ("command", "in", ".rs", r"#\[tauri::command\]\s*(?:pub\s+)?(?:async\s+)?fn\s+([a-z_]\w*)"),
    ("reference", "out", ".ts", r"\buse(?:Mutation|Query|Action)\s*\(\s*api\.([A-Za-z_$][\w$]*\.[A-Za-z_$][\w$]*)"),
]
REQUEST = r"\b(?:fetch|axios\s*\.\s*(?:get|post|put|delete|patch))\s*\(\s*[\"'`](/?api/[^\"'`]+)[\"'`]"
#: How frameworks name routes and tasks: framework, ending of the path, expression whose first group is the route or task.
FRAMEWORKS = [
    ("express", "s", r"\b(?:app|router)\.(?:get|post|put|delete|patch|use)\(" + QUOTED), ("fastapi", ".py", r"@(?:app|router)\.(?:get|post|put|delete|patch|websocket)\(" + QUOTED), ("flask", ".py", r"@\w+\.route\(" + QUOTED), ("django", ".py", r"\b(?:path|re_path)\(" + QUOTED + r"\s*,"),
    ("celery", ".py", r"([A-Za-z_]\w*)\.(?:delay|apply_async)\("), ("spring", ".java", r"@(?:Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:value\s*=\s*)?" + QUOTED), ("aspnet", ".cs", r"\[Http(?:Get|Post|Put|Delete|Patch)\(" + QUOTED), ("rails", ".rb", r"(?m)^\s*(?:get|post|put|patch|delete)\s" + QUOTED),
    ("gin", ".go", r"\b\w+\.(?:GET|POST|PUT|DELETE|PATCH)\(" + QUOTED), ("axum", ".rs", r"\.route\(" + QUOTED), ("laravel", ".php", r"Route::(?:get|post|put|delete|patch)\(" + QUOTED), ("convex", ".ts", r"export\s+const\s+([A-Za-z_$][\w$]*)\s*=\s*(?:mutation|query|action)\s*\("), ("sidekiq", ".rb", r"([A-Z]\w*)\.perform_(?:async|in)\b"),
]
#: Methods that register a handler or trigger one, and their families.
REGISTER = {"on": "event", "once": "event", "addListener": "event", "subscribe": "event", "register": "registry", "registerHandler": "registry"}
TRIGGER = {"emit": "event", "publish": "event", "trigger": "event", "dispatch": "registry", "run": "registry", "execute": "registry", "invoke": "registry"}
DISPATCH = r"(?:([A-Za-z_$][\w$]*)\.)?\b(" + "|".join([*REGISTER, *TRIGGER]) + r")\(\s*[\"'`]([^\"'`]+)[\"'`]\s*(?:,\s*(?:this\.)?([A-Za-z_$][\w$.]*))?"
SAMPLES = [
    (-1, -1, "s/a.ts", 'bus.emit("Lease.Expired", id); bus.on("ready", start); fetch("/api/leases/42"); invoke("seal_all")'), (-2, -1, "s/a.ts", 'bus.on("lease.expired", drop); router.get("/leases/:id", show); ws.send(JSON.stringify({ method: "tail" }))'),
    (-3, -2, "s/b.go", "jobs <- 1\nx := <-jobs\nr.GET(\"/jobs\", list)"), (-4, -3, "s/c.py", "sealed.send(sender=None)\n@app.get('/seals')\nrebuild.delay(1)"), (-5, -4, "s/d.py", "sealed.connect(on_seal)\n@receiver(sealed)\npath('seals/', view)"), (-6, -5, "s/e.rs", 'tx.send(1); rx.recv(); Router::new().route("/x", get(h))\n#[tauri::command]\nfn seal_all() {}'),
    (-7, -6, "s/f.java", '@GetMapping("/tickets")\npublic void f() {}'), (-8, -7, "s/app/api/leases/[id]/route.ts", "export async function GET() {}"), (-9, -8, "s/g.cs", 'Changed?.Invoke(this); Changed += OnChanged; [HttpGet("/c")]'), (-10, -9, "s/h.ts", 'switch (m) { case "tail": break }\nregistry.register("seal", handlers.seal);\nregistry.run("seal");\nuseQuery(api.leases.list)'),
    (-11, -10, "s/app/api/leases/all/route.ts", "export async function GET() {}"), (-12, -11, "s/i.ts", 'fetch("/api/leases/all?x=1")\nemit("only.out")'),
]


def sources(s: SparkSession, d: str) -> DataFrame:
    """(id, file_id, path, source) of symbols and samples."""
    rows = symbols(s, d, "file_id", "full_source").join(files(s, d, "path").withColumnRenamed("id", "file_id"), "file_id").select("id", "file_id", "path", F.col("full_source").alias("source"))
    return rows.unionByName(s.createDataFrame(SAMPLES, "id bigint, file_id bigint, path string, source string"))


def found(rows: DataFrame, rules: list[tuple], names: list[str]) -> DataFrame:
    """What the rules (..., ending, expression) find in sources: (id, file_id, path, names..., value); one pass over the sources for all rules."""
    parts = []
    for *labels, ending, pattern in rules:
        hits = F.expr("regexp_extract_all(source, {}, 1)".format("'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"))
        here = F.when(F.endswith("path", F.lit(ending)), hits).otherwise(F.array().cast("array<string>"))
        parts.append(labelled(here, labels, names))
    return rows.select("id", "file_id", "path", F.explode(F.array_distinct(F.concat(*parts))).alias("x")).select("id", "file_id", "path", "x.*")


def labelled(hits: F.Column, labels: list, names: list[str]) -> F.Column:
    return F.transform(hits, lambda v: F.struct(*[F.lit(x).alias(n) for x, n in zip(labels, names, strict=True)], v.alias("value")))


def members(s, d) -> DataFrame:
    rows = found(sources(s, d), FAMILIES, ["family", "role"])
    return rows.select("family", F.lower(F.trim("value")).alias("channel"), "role", "id").distinct()


def channel_members(s, d):
    """Who emits to and who listens on each channel that has both."""
    rows = members(s, d)
    both = rows.groupBy("family", "channel").agg(F.countDistinct("role").alias("n")).filter("n = 2")
    return rows.join(both.select("family", "channel"), ["family", "channel"], "left_semi").select("family", "channel", "role", "id")


def event_edges(s, d):
    """Channels with emitters, listeners and the number of edges between different symbols."""
    per = members(s, d).groupBy("family", "channel", "id").agg(F.max((F.col("role") == "out").cast("int")).alias("o"), F.max((F.col("role") == "in").cast("int")).alias("i"))
    out = per.groupBy("family", "channel").agg(F.sum("o").alias("emitters"), F.sum("i").alias("listeners"), (F.sum("o") * F.sum("i") - F.sum(F.col("o") * F.col("i"))).alias("edges"))
    return out.filter("edges > 0")


def route_segments(path):
    below = F.regexp_extract(path, r"/(?:app|pages)/api/(.+?)(?:/route)?\.[^/.]+$", 1)
    return F.filter(F.split(F.regexp_replace(below, "/index$", ""), "/"), lambda x: x != "")


def request_edges(s, d):
    """Requests and the route files they reach, segment by segment; [x] in a route stands for anything.

    Routes are joined by the pattern of their fixed places: of each number of segments there are few such patterns, and for each a request has one key.
    """
    rows = sources(s, d)
    asks = found(rows, [("", REQUEST)], []).select("id", F.filter(F.split(F.regexp_replace(P.request_path(F.col("value")), "^/?api/", ""), "/"), lambda x: x != "").alias("seg"))
    routes = rows.select("path").distinct().filter(F.col("path").rlike(r"/(?:app|pages)/api/")).select("path", route_segments(F.col("path")).alias("seg"))
    fixed = lambda seg: F.transform(seg, lambda x: ~x.rlike(r"^\[[^/]+\]$"))
    key = lambda seg, mask: F.array_join(F.zip_with(seg, mask, lambda x, m: F.when(m, x).otherwise("*")), "/")
    routes = routes.select("path", fixed(F.col("seg")).alias("mask"), F.size("seg").alias("n"), key(F.col("seg"), fixed(F.col("seg"))).alias("key"))
    masks = routes.select("n", "mask").distinct()
    asks = asks.withColumn("n", F.size("seg")).join(masks, "n").select("id", "n", key(F.col("seg"), F.col("mask")).alias("key"))
    return asks.join(routes, ["n", "key"]).select("id", "path").distinct()


def framework_routes(s, d):
    return found(sources(s, d), FRAMEWORKS, ["framework"]).select("id", "framework", F.col("value").alias("route")).distinct()


def dispatch_edges(s, d):
    """Handlers that a name triggers: registered and triggered in one file, on one receiver, under one name."""
    group = lambda n: F.expr("regexp_extract_all(source, {}, {})".format("'" + DISPATCH.replace("\\", "\\\\").replace("'", "\\'") + "'", n))
    rows = sources(s, d).select("id", "file_id", F.explode(F.arrays_zip(group(1).alias("receiver"), group(2).alias("method"), group(3).alias("channel"), group(4).alias("handler"))).alias("x")).select("id", "file_id", F.col("x.receiver"), "x.method", F.lower(F.trim("x.channel")).alias("channel"), F.element_at(F.split("x.handler", r"\."), -1).alias("handler"))
    family = lambda known: F.create_map(*[F.lit(x) for item in known.items() for x in item])[F.col("method")]
    regs = rows.withColumn("family", family(REGISTER)).filter("family is not null and handler <> ''").select("file_id", "family", "receiver", "channel", "handler").distinct()
    fires = rows.withColumn("family", family(TRIGGER)).filter("family is not null").select("id", "file_id", "family", "receiver", "channel").distinct()
    return fires.join(regs, ["file_id", "family", "receiver", "channel"]).select("id", "family", "receiver", "channel", "handler")


QUERIES = {f.__name__: f for f in (channel_members, event_edges, request_edges, framework_routes, dispatch_edges)}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SRC = "src as (select s.id, s.file_id, f.path, s.full_source source from " + S + " s join files f on f.id = s.file_id union all select * from (values " + ", ".join(f"({a}, {b}, {q(p)}, {q(t)})" for a, b, p, t in SAMPLES).replace("\\n", "\n") + "))"
MEM = f"{SRC}, me as (" + " union ".join(f"select '{fa}' family, lower(trim(v)) channel, '{ro}' as role, id from (select id, unnest(regexp_extract_all(source, {q(p)}, 1)) v from src where path like '%{e}')" for fa, ro, e, p in FAMILIES) + ")"
SQL = {
    "channel_members": f"with {MEM} select * from me where (family, channel) in (select family, channel from me where role = 'out') and (family, channel) in (select family, channel from me where role = 'in')",
    "event_edges": f"with {MEM} select a.family, a.channel, count(distinct a.id) emitters, count(distinct b.id) listeners, count(*) filter (where a.id <> b.id) edges from me a join me b on a.family = b.family and a.channel = b.channel and a.role = 'out' and b.role = 'in' group by all having count(*) filter (where a.id <> b.id) > 0",
    "request_edges": f"""with {SRC}, a as (select id, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(v, '[?#].*$', ''), '/+', '/', 'g'), '^/?api/', ''), '/'), lambda x: x <> '') seg from (select id, unnest(regexp_extract_all(source, {q(REQUEST)}, 1)) v from src)),
r as (select distinct path, list_filter(string_split(regexp_replace(regexp_extract(path, '/(?:app|pages)/api/(.+?)(?:/route)?\\.[^/.]+$', 1), '/index$', ''), '/'), lambda x: x <> '') seg from src where regexp_matches(path, '/(?:app|pages)/api/'))
select distinct a.id, r.path from a join r on len(a.seg) = len(r.seg) where len(list_filter(range(1, len(a.seg) + 1), lambda i: a.seg[i] <> r.seg[i] and not regexp_full_match(r.seg[i], '\\[[^/]+\\]'))) = 0""",
    "framework_routes": f"with {SRC} " + " union ".join(f"select id, '{fw}' framework, v route from (select id, unnest(regexp_extract_all(source, {q(p)}, 1)) v from src where path like '%{e}')" for fw, e, p in FRAMEWORKS),
    "dispatch_edges": f"""with {SRC}, g as (select id, file_id, unnest(regexp_extract_all(source, {q(DISPATCH)}, 1)) receiver, unnest(regexp_extract_all(source, {q(DISPATCH)}, 2)) as method, lower(trim(unnest(regexp_extract_all(source, {q(DISPATCH)}, 3)))) channel, (string_split(unnest(regexp_extract_all(source, {q(DISPATCH)}, 4)), '.'))[-1] handler from src),
fam as (select *, case when method in ('on', 'once', 'addListener', 'subscribe', 'emit', 'publish', 'trigger') then 'event' else 'registry' end family, method in ('emit', 'publish', 'trigger', 'dispatch', 'run', 'execute', 'invoke') fires from g)
select distinct a.id, a.family, a.receiver, a.channel, b.handler from fam a join fam b on a.file_id = b.file_id and a.family = b.family and a.receiver = b.receiver and a.channel = b.channel where a.fires and not b.fires and b.handler <> ''""",
}
