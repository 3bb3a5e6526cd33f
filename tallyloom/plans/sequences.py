"""State machines over events, reducers, graphs and set comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalog import query, table
from tallyloom.operators import machines as M
from tallyloom.operators import sequences as S


def machine_sql(machine: S.Machine, symbol: str) -> str:
    """The machine as a recursive query over each user's events."""
    rows = ", ".join(f"('{s}', '{x}', '{n}', {'NULL' if o is None else chr(39) + o.replace(chr(39), chr(39) * 2) + chr(39)})" for (s, x), (n, o) in machine.transitions.items())
    stop = "r.state NOT IN (" + ", ".join(f"'{s}'" for s in sorted(machine.stop)) + ")" if machine.stop else "true"
    return f"""WITH RECURSIVE t(state, x, nxt, out) AS (VALUES {rows}),
e AS (SELECT user_id, {symbol} AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r(user_id, rn, state, rejected, outs) AS (
  SELECT DISTINCT user_id, 0::BIGINT, '{machine.start}', false, []::VARCHAR[] FROM e
  UNION ALL
  SELECT r.user_id, e.rn, coalesce(t.nxt, r.state), {'t.nxt IS NULL' if machine.undefined == S.REJECT else 'false'}, CASE WHEN t.out IS NULL THEN r.outs ELSE list_append(r.outs, t.out) END
  FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1 LEFT JOIN t ON t.state = r.state AND t.x = e.x
  WHERE NOT r.rejected AND {stop}),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1)"""


def ran(spark, sf_dir, machine, symbol, counted=None):
    """Each user's machine, from daily pieces."""
    return S.run_in_pieces(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.expr(symbol), machine, F.to_date("ts"), counted)


TURNSTILE_IN = "CASE event_type WHEN 'purchase' THEN 'bezahlen' WHEN 'view' THEN 'durchgehen' ELSE 'warten' END"
SHOP_IN = "CASE event_type WHEN 'click' THEN 'checkout' WHEN 'purchase' THEN 'pay' WHEN 'error' THEN 'error' WHEN 'view' THEN 'back' ELSE 'wait' END"
BIT_IN = "CASE WHEN event_type IN ('click', 'purchase') THEN '1' ELSE '0' END"
FORM_IN = "CASE event_type WHEN 'signup' THEN 'Event_sub' WHEN 'view' THEN 'voll' WHEN 'click' THEN 'mail' WHEN 'purchase' THEN 'visa' ELSE 'nomail' END"


@query(f"{machine_sql(S.TURNSTILE, TURNSTILE_IN)} SELECT user_id, state, state = 'Zu' AS locked, rn AS \"read\" FROM f")
def fsm_turnstile(spark, sf_dir):
    return ran(spark, sf_dir, S.TURNSTILE, TURNSTILE_IN).select("user_id", "state", (F.col("state") == "Zu").alias("locked"), "read")


@query(f"{machine_sql(S.SHOP, SHOP_IN)} SELECT user_id, state, state = 'Deal' AS paid, outs[1] AS error, rn AS \"read\" FROM f")
def fsm_shop(spark, sf_dir):
    return ran(spark, sf_dir, S.SHOP, SHOP_IN).select("user_id", "state", (F.col("state") == "Deal").alias("paid"), F.col("first").alias("error"), "read")


@query(f"{machine_sql(S.PATTERN_101, BIT_IN)} SELECT user_id, state, len(list_filter(outs, lambda o: o = 'treffer'))::BIGINT AS hits FROM f")
def fsm_pattern101(spark, sf_dir):
    return ran(spark, sf_dir, S.PATTERN_101, BIT_IN, "treffer").select("user_id", "state", "hits")


@query(f"{machine_sql(S.FORM, FORM_IN)} SELECT user_id, state, NOT rejected AND state = 'q4' AS valid FROM f")
def fsm_form(spark, sf_dir):
    return ran(spark, sf_dir, S.FORM, FORM_IN).select("user_id", "state", (~F.col("rejected") & F.col("state").isin(list(S.FORM.final))).alias("valid"))


@query(f"{machine_sql(S.PARITY, BIT_IN)} SELECT user_id, state, outs[-1] AS output FROM f")
def fsm_json_parity(spark, sf_dir):
    return ran(spark, sf_dir, S.PARITY, BIT_IN).select("user_id", "state", F.col("last").alias("output"))


@query(f"{machine_sql(S.TURNSTILE, TURNSTILE_IN)} SELECT user_id, state FROM f")
def fsm_turnstile_chunked(spark, sf_dir):
    """The same final states from hourly pieces."""
    return S.run_in_pieces(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.expr(TURNSTILE_IN), S.TURNSTILE, F.date_trunc("hour", "ts")).select("user_id", "state")


@query(f"{machine_sql(S.FORM, FORM_IN)} SELECT user_id, NOT rejected AND state = 'q4' AS valid FROM f")
def fsm_form_chunked(spark, sf_dir):
    ends = S.run_in_pieces(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.expr(FORM_IN), S.FORM, F.date_trunc("hour", "ts"))
    return ends.select("user_id", (~F.col("rejected") & (F.col("state") == "q4")).alias("valid"))


MICROWAVE_IN = "CASE event_type WHEN 'view' THEN 'schliessen' WHEN 'click' THEN 'starten' WHEN 'purchase' THEN 'warten' ELSE 'öffnen' END"
DRINKS_IN = "CASE event_type WHEN 'purchase' THEN 'abbrechen' WHEN 'view' THEN 'warten' ELSE '1€ einwerfen' END"
COINS_IN = "CASE event_type WHEN 'purchase' THEN 'abbrechen' ELSE '1€ einwerfen' END"


@query(f"{machine_sql(S.MICROWAVE, MICROWAVE_IN)} SELECT user_id, state, state = 'OK' AS done FROM f")
def fsm_microwave(spark, sf_dir):
    return ran(spark, sf_dir, S.MICROWAVE, MICROWAVE_IN).select("user_id", "state", (F.col("state") == "OK").alias("done"))


def outputs_sql(machine: S.Machine, symbol: str) -> str:
    """Every output of every user's machine, with the event that made it."""
    seeds = "".join(f" UNION ALL SELECT DISTINCT user_id, -1, '{machine.start}', '{o}' FROM events" for o in machine.seed)
    cte = machine_sql(machine, symbol).split(",\nf AS (")[0]
    cte = cte.replace("SELECT user_id, ", "SELECT user_id, event_id, ", 1)
    cte = cte.replace("r(user_id, rn, state, rejected, outs)", "r(user_id, rn, state, rejected, event_id, out)").replace("false, []::VARCHAR[] FROM e", "false, NULL::BIGINT, NULL::VARCHAR FROM e")
    cte = cte.replace("CASE WHEN t.out IS NULL THEN r.outs ELSE list_append(r.outs, t.out) END", "e.event_id, t.out")
    return f"{cte} SELECT user_id, event_id, state, out AS output FROM r WHERE out IS NOT NULL{seeds}"


def outputs(spark, sf_dir, machine, symbol):
    """What a machine says before any input has -1 as its event."""
    out = M.outputs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.expr(symbol), machine)
    return out.select("user_id", F.coalesce("event_id", F.lit(-1)).alias("event_id"), "state", "output")


QUATER_IN = "CASE event_id % 4 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' ELSE '3' END"
PARKING_IN = "CASE event_type WHEN 'purchase' THEN 'drucken' WHEN 'click' THEN '2€' ELSE '1€' END"
LETTER_IN = "CASE WHEN event_type IN ('view', 'signup') THEN 'b' ELSE 'a' END"


@query(outputs_sql(S.MOORE_DRINKS, DRINKS_IN))
def fsm_moore(spark, sf_dir):
    return outputs(spark, sf_dir, S.MOORE_DRINKS, DRINKS_IN)


@query(outputs_sql(S.MEALY_DRINKS, COINS_IN))
def fsm_mealy(spark, sf_dir):
    return outputs(spark, sf_dir, S.MEALY_DRINKS, COINS_IN)


@query(outputs_sql(S.ADDER, QUATER_IN))
def fsm_json_adder(spark, sf_dir):
    """The sum's digits, lowest first."""
    return outputs(spark, sf_dir, S.ADDER, QUATER_IN)


@query(outputs_sql(S.TRAFFIC_LIGHT, "'takt'"))
def fsm_traffic_light(spark, sf_dir):
    return outputs(spark, sf_dir, S.TRAFFIC_LIGHT, "'takt'")


@query(outputs_sql(S.PARKING, PARKING_IN))
def fsm_parking(spark, sf_dir):
    return outputs(spark, sf_dir, S.PARKING, PARKING_IN)


@query(outputs_sql(S.INVERTER, BIT_IN))
def fsm_inverter(spark, sf_dir):
    return outputs(spark, sf_dir, S.INVERTER, BIT_IN)


@query(outputs_sql(S.DETECTOR_AB, LETTER_IN))
def fsm_detector_ab(spark, sf_dir):
    return outputs(spark, sf_dir, S.DETECTOR_AB, LETTER_IN)


@query(f"{machine_sql(S.DETECTOR_11, BIT_IN)} SELECT user_id, state, state = 'q2' AS accepted, rn AS \"read\" FROM f")
def fsm_detector_11(spark, sf_dir):
    return M.ends(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.expr(BIT_IN), S.DETECTOR_11).select("user_id", "state", "accepted", "read")


RAG_IN = "CASE event_type WHEN 'signup' THEN 'run not' WHEN 'click' THEN 'auto ok' WHEN 'view' THEN 'run not' ELSE 'auto not' END"


@query(f"{machine_sql(S.RAG, RAG_IN)} SELECT user_id, state, state IN ('generated', 'failed') AS accepted FROM f")
def fsm_rag(spark, sf_dir):
    return M.ends(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.expr(RAG_IN), S.RAG).select("user_id", "state", "accepted")


@query(f"{machine_sql(S.RAG_LOOP, RAG_IN)} SELECT user_id, state, state IN ('accepted', 'final_gen') AS accepted FROM f")
def fsm_rag_loop(spark, sf_dir):
    return M.ends(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.expr(RAG_IN), S.RAG_LOOP).select("user_id", "state", "accepted")


#: A graph for each document: a ring of 2 to 11 nodes, one or two chords, a tail that leaves it.
RING = "(doc_id % 10 + 2)"
EDGES = [("k", f"(k + 1) % {RING}", f"k < {RING}"), ("0", f"doc_id % 7 % {RING}", "k = 0"), ("1", "doc_id % 3", "k = 0 AND doc_id % 2 = 0"), ("1", "12", "k = 0"), ("12", "13", "k = 0")]
NODE = "lpad(CAST({} AS {t}), 2, '0')"


@query("WITH RECURSIVE e AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, {NODE.format(a, t='VARCHAR')} AS source, {NODE.format(b, t='VARCHAR')} AS target FROM documents, range(12) t(k) WHERE {w}" for a, b, w in EDGES) + ")), p(doc_id, path, cur) AS (SELECT doc_id, [source], target FROM e UNION ALL SELECT p.doc_id, list_append(p.path, p.cur), e.target FROM p JOIN e ON e.doc_id = p.doc_id AND e.source = p.cur WHERE p.cur > p.path[1] AND NOT list_contains(p.path, p.cur)) SELECT doc_id, array_to_string(path, '>') AS cycle, len(path)::BIGINT AS n FROM p WHERE cur = path[1]")
def graph_cycles(spark, sf_dir):
    return S.cycles(graphs(spark, sf_dir), "doc_id")


def graphs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "explode(sequence(0L, 11L)) AS k")
    parts = [rows.where(w).selectExpr("doc_id", f"{NODE.format(a, t='STRING')} AS source", f"{NODE.format(b, t='STRING')} AS target") for a, b, w in EDGES]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


@query("WITH RECURSIVE e AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, {NODE.format(a, t='VARCHAR')} AS source, {NODE.format(b, t='VARCHAR')} AS target FROM documents, range(12) t(k) WHERE {w}" for a, b, w in EDGES) + ")), r(doc_id, a, b) AS (SELECT doc_id, source, target FROM e UNION SELECT r.doc_id, r.a, e.target FROM r JOIN e ON e.doc_id = r.doc_id AND e.source = r.b) SELECT x.doc_id, x.a AS node, min(x.b) AS component FROM r x JOIN r y ON y.doc_id = x.doc_id AND y.a = x.b AND y.b = x.a GROUP BY 1, 2")
def graph_components(spark, sf_dir):
    """The strongly connected components of every document's graph that hold a cycle."""
    return S.strong_components(graphs(spark, sf_dir), "doc_id")


@query("WITH s AS (SELECT doc_id, 'n' || k AS node FROM documents, range(5) t(k) WHERE (doc_id + k) % 4 > 0), g AS (SELECT doc_id, 'n' || k AS node FROM documents, range(6) t(k) WHERE (doc_id + k) % 5 > 0) SELECT doc_id, node, 'only_spec' AS problem FROM s WHERE (doc_id, node) NOT IN (SELECT doc_id, node FROM g) UNION ALL SELECT doc_id, node, 'only_graph' FROM g WHERE (doc_id, node) NOT IN (SELECT doc_id, node FROM s)")
def spec_set_compare(spark, sf_dir):
    """Nodes of each specification against those of its diagram, pseudo-nodes left out."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "explode(sequence(0L, 7L)) AS k")
    spec = rows.where("k < 5 and (doc_id + k) % 4 > 0").selectExpr("doc_id", "'n' || k AS node")
    drawn = rows.where("k > 5 or (doc_id + k) % 5 > 0").selectExpr("doc_id", "CASE k WHEN 6 THEN 'START' WHEN 7 THEN 'END' ELSE 'n' || k END AS node")
    drawn = drawn.where(~F.col("node").isin("START", "END"))
    return spec.subtract(drawn).withColumn("problem", F.lit("only_spec")).unionByName(drawn.subtract(spec).withColumn("problem", F.lit("only_graph")))


@query("SELECT conv_id, count(*) AS n, array_to_string(list(role ORDER BY turn), ',') AS roles FROM conversations GROUP BY 1")
def reduce_append(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return rows.select("conv_id", "n", F.array_join(F.col("x.role"), ",").alias("roles"))


UPDATES = "SELECT user_id % 20 AS block_id, event_id AS seq, event_type AS field, cast(event_id % 97 AS {s}) AS value FROM events"


@query("WITH u AS (" + UPDATES.format(s="VARCHAR") + ") SELECT block_id, min(seq) AS first_seq, arg_max(value, seq) FILTER (WHERE field = 'click') AS click, arg_max(value, seq) FILTER (WHERE field = 'purchase') AS purchase, array_to_string(coalesce(list(value ORDER BY seq) FILTER (WHERE field = 'error'), []), ',') AS error FROM u GROUP BY 1")
def reduce_merge(spark, sf_dir):
    updates = spark.sql(UPDATES.format(s="STRING").replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    merged = S.merge_updates(updates, "block_id", "seq", ["click", "purchase"], ["error"], F.expr("seq div 5000"))
    return merged.withColumn("error", F.array_join("error", ","))
