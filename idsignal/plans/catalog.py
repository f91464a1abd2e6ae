"""Registered queries, each with the SQL that checks it where SQL can."""

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from idsignal import fixed_values as fv
from idsignal import schemas
from idsignal.functions import checks, rules, scores
from idsignal.functions.ip import extract_ip, repair_ip
from idsignal.functions.numeric import round_half_up
from idsignal.functions.risk import with_risk
from idsignal.functions.times import iso_text
from idsignal.operators import anomaly, enrich, events, forest, fusion, metrics, reports, scaling, warehouse
from idsignal.operators.lookup import lookup
from idsignal.plans import analysis, fixtures as fx, fusion_sql
from idsignal.sources import files, lines, payloads, sinks
from idsignal.streaming import alerts as streams, cards
from idsignal.workspace import fresh_path, shared_dir, stage, together

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


# -- shared inputs ----------------------------------------------------------------


def ct_events(spark: SparkSession, sf: str) -> DataFrame:
    return fx.derive(spark, sf, fx.CT_EVENTS).withColumn("pos", F.col("event_id") % 100)


def scored_events(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.analyze_events(ct_events(spark, sf))


def flat_logs(spark: SparkSession, sf: str) -> DataFrame:
    return fx.derive(spark, sf, fx.ENRICHED_FLAT).withColumnRenamed("user_name", "user")


def sightings(spark: SparkSession, sf: str) -> DataFrame:
    return fx.derive(spark, sf, fx.SIGHTINGS).withColumnRenamed("user_name", "user")


def dimensions(logs: DataFrame) -> list[DataFrame]:
    """Users, actions and addresses of the logs, as written tables."""
    return together(
        lambda: stage(warehouse.new_dimension(logs, "user", "username", "user_id"), "users"),
        lambda: stage(warehouse.new_dimension(logs, "action", "action_name", "action_id"), "actions"),
        lambda: stage(warehouse.new_ip_dimension(logs, "id"), "ip_details"),
    )


def wh_dims(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(fx.derive(spark, sf, text) for text in (fx.WH_USERS, fx.WH_ACTIONS, fx.WH_IPS))


def wh_fact(spark: SparkSession, sf: str) -> DataFrame:
    return fx.derive(spark, sf, fx.WH_FACT)


def event_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alert-store rows of the audit events."""
    return analysis.alert_rows(
        with_risk(events.parse_events(ct_events(spark, sf))), F.col("event_id"), F.col("event_ts"), F.col("log_type"))


# -- shared SQL --------------------------------------------------------------------

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def sql_ip(text: str) -> str:
    token = rf"regexp_extract({text}, '\b([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}\b', 0)"
    return f"case when regexp_full_match({token}, '({OCTET}[.]){{3}}{OCTET}') then {token} else 'unknown' end"


def sql_list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{value}'" for value in values) + ")"


def sql_mean(value: str) -> str:
    return f"avg({value})"


def sql_round(value: str, places: int) -> str:
    return f"(floor({value} * 1e{places} + 0.5) / 1e{places})"


def sql_even(value: str, places: int) -> str:
    return f"round_even({value}, {places})"


def sql_capitalize(text: str) -> str:
    return f"(upper(substr({text}, 1, 1)) || lower(substr({text}, 2)))"


def sql_names(key: str, names: dict[str, str], otherwise: str) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in names.items()) + f" else {otherwise} end"


PARSED = f"""
select *, cast(row_number() over (partition by request_id order by event_id) - 1 as integer) as pos,
 coalesce(user_name, arn, 'unknown') as "user", coalesce(event_name, 'unknown') as action,
 {sql_ip('source_ip_address')} as src_ip, coalesce(aws_region, 'unknown') as region,
 case when length(error_code) > 0 then 'FAILED' else 'SUCCESS' end as result,
 case when event_source is not null and event_name is not null
   then case when event_source = 'iam.amazonaws.com' then 'aws_iam' else 'aws_cloudtrail' end
  when (user_name is not null or arn is not null) and event_name is not null then 'aws_cloudtrail' else 'unknown' end as log_type
from ct_events
"""

RULES = f"""
select *, action in {sql_list(fv.SENSITIVE_ACTIONS)} as sensitive, action in {sql_list(fv.ELEVATED_ACTIONS)} as elevated,
 result = 'FAILED' as failed, src_ip <> 'unknown' and not (starts_with(src_ip, '10.') or starts_with(src_ip, '172.')
  or starts_with(src_ip, '192.168.')) as outside, action in {sql_list(fv.TAMPERING_ACTIONS)} as tampering
from parsed
"""

LEVEL = "case when risk_score >= 80 then 'CRITICAL' when risk_score >= 60 then 'HIGH' when risk_score >= 35 then 'MEDIUM' else 'LOW' end"

SCORED = f"""
select *, {LEVEL} as priority from (select *, least(100, 50 * cast(sensitive as int) + 25 * cast(elevated as int)
 + 20 * cast(failed as int) + 15 * cast(outside as int) + 30 * cast(tampering as int)) as risk_score from rules)
"""

CT = {"ct_events": fx.CT_EVENTS, "parsed": PARSED, "rules": RULES, "scored": SCORED}
REASONS = f"""concat_ws(' | ', case when sensitive then '{fv.SENSITIVE_REASON}' || action end,
 case when elevated then '{fv.ELEVATED_REASON}' || action end, case when failed then '{fv.FAILURE_REASON}' end,
 case when outside then '{fv.EXTERNAL_REASON}' || src_ip end, case when tampering then '{fv.TAMPERING_REASON}' end)"""
SUMMARY = """priority || ' alert detected for user ' || "user" || '. Action: ' || action || '. Source IP: ' || src_ip || '.'"""
ADVICE = f"""case priority when 'CRITICAL' then '{" | ".join(fv.RECOMMENDATIONS["CRITICAL"])}'
 when 'HIGH' then '{" | ".join(fv.RECOMMENDATIONS["HIGH"])}' else '{" | ".join(fv.DEFAULT_RECOMMENDATIONS)}' end"""
STORE = """
select event_id as id, event_ts as "timestamp", src_ip, "user", log_type as event_type, priority as severity, risk_score,
 cast(null as varchar) as ai_reasoning, 'OPEN' as status from scored
"""
FLAT = {"flat": fx.ENRICHED_FLAT}
WH = {"users": fx.WH_USERS, "actions": fx.WH_ACTIONS, "ips": fx.WH_IPS, "fact": fx.WH_FACT}
NUMBER = "row_number() over (order by substr(md5({0}), 1, 3), {0})"


# -- requests and audit events --------------------------------------------------------


@query("ct_payload_scan", fx.oracle(ct_events=fx.CT_EVENTS, parsed=PARSED) + """
select request_id, pos, strftime(event_ts, '%Y-%m-%dT%H:%M:%SZ') as event_time, event_name, user_name, arn,
 source_ip_address, aws_region, event_source, error_code, length(coalesce(error_code, '')) > 0 as has_error from parsed""")
def ct_payload_scan(spark, sf):
    requests = fx.payload_requests(ct_events(spark, sf))
    return payloads.event_fields(payloads.scan_elements(requests, keep_raw=False)).drop("has_identity")


@query("payload_quarantine", fx.oracle(ct_events=fx.CT_EVENTS) + f"""
select event_id as request_id, v.pos, v.rejected
from ct_events join (values ('cut off', 0, '{payloads.MALFORMED}'), ('null', 0, '{payloads.NOT_AN_EVENT}'),
 ('mixed', 1, '{payloads.NOT_AN_EVENT}'), ('mixed', 2, '{payloads.NOT_AN_EVENT}'), ('mixed', 3, '{payloads.NOT_AN_EVENT}'))
 as v(shape, pos, rejected) on v.shape = ct_events.shape""")
def payload_quarantine(spark, sf):
    return payloads.quarantined(payloads.scan_elements(fx.payload_cases(ct_events(spark, sf)), keep_raw=False))


@query("ct_parsed", fx.oracle(**CT) + """
select event_id, event_ts, "user", action, src_ip, region, result, error_code, log_type from parsed""")
def ct_parsed(spark, sf):
    return events.parse_events(ct_events(spark, sf)).select(
        "event_id", "event_ts", "user", "action", "src_ip", "region", "result", "error_code", "log_type")


@query("ip_extract", fx.oracle(ct_events=fx.CT_EVENTS) + f"""
select event_id, source_ip_address, {sql_ip('source_ip_address')} as src_ip from ct_events""")
def ip_extract(spark, sf):
    return ct_events(spark, sf).select(
        "event_id", "source_ip_address", extract_ip(F.col("source_ip_address")).alias("src_ip"))


LOG_TYPE_CASES = """
select event_id, case event_id % 5 when 0 then 'iam.amazonaws.com' when 1 then 's3.amazonaws.com' else null end as event_source,
 case event_id % 3 when 0 then null else 'ListUsers' end as event_name, event_id % 2 = 0 as has_identity
from {events}
"""


@query("ct_log_type", fx.oracle(cases=LOG_TYPE_CASES) + """
select event_id, case when event_name is null then 'unknown' when event_source = 'iam.amazonaws.com' then 'aws_iam'
 when event_source is not null or has_identity then 'aws_cloudtrail' else 'unknown' end as log_type from cases""")
def ct_log_type(spark, sf):
    cases = fx.derive(spark, sf, LOG_TYPE_CASES)
    kind = payloads.log_type(F.col("event_source"), F.col("event_name"), F.col("has_identity"))
    return cases.select("event_id", kind.alias("log_type"))


@query("risk_scored", fx.oracle(**CT) + """
select event_id, request_id, "user", action, src_ip, result, risk_score, priority from scored""")
def risk_scored(spark, sf):
    return with_risk(events.parse_events(ct_events(spark, sf))).select(
        "event_id", "request_id", "user", "action", "src_ip", "result", "risk_score", "priority")


@query("risk_reasons", fx.oracle(**CT) + f"""
select event_id, {REASONS} as reasons,
 cast(sensitive as int) + cast(elevated as int) + cast(failed as int) + cast(outside as int) + cast(tampering as int) as fired
from rules""")
def risk_reasons(spark, sf):
    return with_risk(events.parse_events(ct_events(spark, sf))).select(
        "event_id", F.array_join("reasons", " | ").alias("reasons"), F.size("reasons").alias("fired"))


# A second version of the built-in rules: failures count more and are told first, tampering is gone, two rules are new.
OWN_RULES = [
    rules.Rule("failure", "result", "in", 35, "Failure of ", ("FAILED",), "user"),
    *[r for r in rules.BUILT_IN if r.name not in ("failure", "tampering")],
    rules.Rule("foreign region", "region", "not in", 10, "Region not in use: ", ("us-east-1", fv.UNKNOWN), "region"),
    rules.Rule("listing", "action", "starts with", 5, "Reads only", ("List", "Get")),
]


@query("risk_own_rules", fx.oracle(**CT) + f"""
, own as (select *, result = 'FAILED' as f, region not in ('us-east-1', 'unknown') as g, action like 'List%' or action like 'Get%' as r from rules),
own_scored as (select *, least(100, 35 * f::int + 50 * sensitive::int + 25 * elevated::int + 15 * outside::int + 10 * g::int + 5 * r::int) as risk_score from own)
select event_id, risk_score, {LEVEL} as priority, concat_ws(' | ', case when f then 'Failure of ' || "user" end,
 case when sensitive then '{fv.SENSITIVE_REASON}' || action end, case when elevated then '{fv.ELEVATED_REASON}' || action end,
 case when outside then '{fv.EXTERNAL_REASON}' || src_ip end, case when g then 'Region not in use: ' || region end,
 case when r then 'Reads only' end) as reasons from own_scored""")
def risk_own_rules(spark, sf):
    """Events scored by the newest version of a written rule table."""
    path = fresh_path(spark, "rules")
    rules.as_table(spark, rules.BUILT_IN, 1).unionByName(rules.as_table(spark, OWN_RULES, 2)).write.parquet(path)
    by = rules.from_table(spark.read.parquet(path))
    scored = with_risk(events.parse_events(ct_events(spark, sf)), by=by)
    return scored.select("event_id", "risk_score", "priority", F.array_join("reasons", " | ").alias("reasons"))


@query("alert_explained", fx.oracle(**CT) + f"select event_id, {SUMMARY} as summary, {ADVICE} as recommendations from scored")
def alert_explained(spark, sf):
    return scored_events(spark, sf).select(
        "event_id", "explanation.summary", F.array_join("explanation.recommendations", " | ").alias("recommendations"))


@query("request_summary", fx.oracle(**CT) + """
select request_id, total_logs, total_logs as total_alerts, pos as top_pos, action as top_action,
 risk_score as top_risk_score, priority as top_priority
from (select *, count(*) over (partition by request_id) as total_logs,
  row_number() over (partition by request_id order by risk_score desc, pos) as place from scored) where place = 1""")
def request_summary(spark, sf):
    return reports.request_summary(analysis.analyze_payloads(fx.payload_requests(ct_events(spark, sf)), keep_raw=False))


@query("payload_analysis", fx.oracle(**CT) + f"""
select request_id, pos, strftime(event_ts, '%Y-%m-%dT%H:%M:%SZ') as "timestamp", "user", action, src_ip, region, result, error_code,
 log_type, risk_score, priority, {REASONS} as reasons, {SUMMARY} as summary, {ADVICE} as recommendations from scored""")
def payload_analysis(spark, sf):
    alerts = analysis.analyze_payloads(fx.payload_requests(ct_events(spark, sf)), keep_raw=False)
    return alerts.select(
        "request_id", "pos", "timestamp", "user", "action", "src_ip", "region", "result", "error_code", "log_type",
        "risk_score", "priority", F.array_join("reasons", " | ").alias("reasons"), "explanation.summary",
        F.array_join("explanation.recommendations", " | ").alias("recommendations"))


@query("kpi_cards", fx.oracle(**CT) + """
select event_id as request_id, cast(n as bigint) as total_logs, cast(n as bigint) as total_alerts,
 case when n = 0 then 0 when shape = 'two events' then 100 else risk_score end as highest_risk,
 case when n = 0 then 'SAFE' when shape = 'two events' then 'CRITICAL' else priority end as top_priority
from (select *, case when shape in ('array', 'object') then 1 when shape in ('mixed', 'two events') then 2 else 0 end as n from scored)""")
def kpi_cards(spark, sf):
    elements = payloads.scan_elements(fx.payload_cases(ct_events(spark, sf)), keep_raw=False, keep_empty=True)
    return reports.kpi_cards(with_risk(events.parse_events(payloads.event_fields(elements, keep_empty=True))))


@query("risk_trend", fx.oracle(**CT) + """
select request_id, row_number() over (partition by request_id order by risk_score desc, pos) as t, event_id, risk_score as v
from scored""")
def risk_trend(spark, sf):
    alerts = with_risk(events.parse_events(ct_events(spark, sf))).select("request_id", "pos", "event_id", "risk_score")
    return reports.ranked_alerts(alerts).select("request_id", "t", "event_id", F.col("risk_score").alias("v"))


SEVERITY = """select l.name, count(s.event_id) as v
from (values ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) as l(name) left join scored s on s.priority = l.name group by l.name"""


@query("severity_breakdown", fx.oracle(**CT) + SEVERITY)
def severity_breakdown(spark, sf):
    return reports.severity_breakdown(with_risk(events.parse_events(ct_events(spark, sf))))


@query("action_breakdown", fx.oracle(**CT) + "select action as name, count(*) as v from scored group by action")
def action_breakdown(spark, sf):
    return reports.action_breakdown(events.parse_events(ct_events(spark, sf)))


@query("breakdown_share", fx.oracle(**CT) + f"""
, severity as ({SEVERITY}), actions as (select action as name, count(*) as v from scored group by action)
select 'severity' as panel, name, v, cast(v as double) / (select greatest(max(v), 1) from severity) * 100.0 as share from severity
union all select 'action', name, v, cast(v as double) / (select greatest(max(v), 1) from actions) * 100.0 from actions""")
def breakdown_share(spark, sf):
    alerts = with_risk(events.parse_events(ct_events(spark, sf)))
    panels = [("severity", reports.severity_breakdown(alerts)), ("action", reports.action_breakdown(alerts))]
    shown = [reports.breakdown_share(df).select(F.lit(panel).alias("panel"), "name", "v", "share") for panel, df in panels]
    return shown[0].unionByName(shown[1])


# -- raw lines, cleaning, validation ----------------------------------------------------


@query("raw_line_normalize", fx.oracle(raw_lines=fx.RAW_LINES) + f"""
select event_id, raw_log, 'UNKNOWN' as event_type, {sql_ip('raw_log')} as src_ip, cast(null as varchar) as "user"
from raw_lines""")
def raw_line_normalize(spark, sf):
    return lines.normalize_lines(fx.derive(spark, sf, fx.RAW_LINES)).drop("event_ts")


@query("raw_line_auth", fx.oracle(raw_lines=fx.RAW_LINES) + f"""
select event_id, raw_log, case when failed then 'FAILED_LOGIN' else 'UNKNOWN' end as event_type, {sql_ip('raw_log')} as src_ip,
 case when failed and contains(raw_log, 'root') then 'root' end as "user"
from (select *, contains(raw_log, 'sshd') or contains(raw_log, 'Failed password') as failed from raw_lines)""")
def raw_line_auth(spark, sf):
    return lines.normalize_lines(fx.derive(spark, sf, fx.RAW_LINES), auth_rule=True).drop("event_ts")


@query("line_files", fx.oracle(raw_lines=fx.RAW_LINES) + f"""
select raw_log, 'UNKNOWN' as event_type, {sql_ip('raw_log')} as src_ip, cast(null as varchar) as "user" from raw_lines""")
def line_files(spark, sf):
    """Lines written as text files and read again."""
    path = fresh_path(spark, "lines")
    fx.derive(spark, sf, fx.RAW_LINES).select("raw_log").write.text(path)
    return lines.normalize_lines(lines.read_lines(spark, path))


@query("raw_landing", fx.oracle(raw_lines=fx.RAW_LINES) + f"""
select event_id as id, raw_log, cast(json_object('event_type', 'UNKNOWN', 'src_ip', {sql_ip('raw_log')}, 'raw', raw_log) as varchar)
 as normalized, false as processed, event_ts as created_at from raw_lines""")
def raw_landing(spark, sf):
    return analysis.raw_landing(fx.derive(spark, sf, fx.RAW_LINES), F.col("event_ts"), F.col("event_id"))


@query("preprocess", fx.oracle(extract=fx.CSV_EXTRACT) + """
select strftime(try_cast(eventTime as timestamp), '%Y-%m-%d %H:%M:%S') as "timestamp", userIdentityuserName as "user",
 eventName as action, sourceIPAddress as src_ip, result, cast(null as boolean) as result_flag, cast(null as double) as alert_score,
 cast(null as varchar) as prelim_priority, cast(null as varchar) as ti_country, cast(null as varchar) as ti_asn from extract""")
def preprocess(spark, sf):
    clean = events.preprocess(fx.derive(spark, sf, fx.CSV_EXTRACT).drop("event_id"))
    return clean.withColumn("timestamp", iso_text(F.col("timestamp")))


@query("csv_extract_scan", ORACLES["preprocess"])
def csv_extract_scan(spark, sf):
    """Columns are found by their names in the header, whose order is not the schema's."""
    path = fresh_path(spark, "extract")
    written = fx.derive(spark, sf, fx.CSV_EXTRACT).drop("event_id")
    sinks.write_csv(written.select(*reversed(written.columns)), path)
    extract = files.read_csv(spark, path, T.StructType([*schemas.CSV_EXTRACT.fields, T.StructField("result", T.StringType())]))
    clean = events.preprocess(extract.where(F.col(files.CORRUPT).isNull()))
    return clean.withColumn("timestamp", iso_text(F.col("timestamp")))


CLEAN = "case when {0} is null or lower(trim({0})) in ('nan', 'none', '', 'null') then 'Unknown' else trim({0}) end"
INGEST = "2024-02-01 00:00:00"
ADAPTED = f"""
select event_id, strftime(coalesce(try_cast(eventtime as timestamp), timestamp '{INGEST}'), '%Y-%m-%d %H:%M:%S') as event_time,
 lower({CLEAN.format('eventname')}) as event_name, {CLEAN.format('useridentityusername')} as "user",
 {CLEAN.format('useridentityusername')} as user_identity, {CLEAN.format('sourceipaddress')} as source_ip,
 {CLEAN.format('awsregion')} as aws_region, {CLEAN.format('eventsource')} as event_source, 0 as is_failure,
 coalesce(is_login, 0) as is_login, coalesce(is_iam, 0) as is_iam, 0 as is_ec2, coalesce(is_s3, 0) as is_s3 from flagged
"""


def adapted(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.derive(spark, sf, fx.FLAGGED_EVENTS)
    return events.adapt_events(rows, F.lit(INGEST).cast("timestamp"), keep=["event_id"])


@query("adapt_events", fx.oracle(flagged=fx.FLAGGED_EVENTS) + ADAPTED)
def adapt_events(spark, sf):
    return adapted(spark, sf).withColumn("event_time", iso_text(F.col("event_time")))


@query("event_class", fx.oracle(flagged=fx.FLAGGED_EVENTS, adapted=ADAPTED) + """
select event_id, case when is_login <> 0 then 'authentication' when is_iam <> 0 then 'authorization'
 when is_s3 <> 0 then 'data_access' else 'infrastructure' end as event_class from adapted""")
def event_class(spark, sf):
    return adapted(spark, sf).select("event_id", events.event_class().alias("event_class"))


BLANK_IP = "(src_ip is null or lower(trim(src_ip)) in ('', '-', 'unknown', 'none', 'nan'))"
REPAIRED = f"""
select event_id, src_ip as original, case when not {BLANK_IP} then array_to_string(list_transform(
 list_concat(list_filter(string_split(trim(src_ip), '.'), lambda p: regexp_full_match(p, '[0-9]+')), ['0', '0', '0', '0'])[1:4],
 lambda p: cast(least(cast(p as hugeint), 255) as varchar)), '.') end as src_ip from broken
"""


@query("ip_repair", fx.oracle(broken=fx.BROKEN_IPS) + REPAIRED)
def ip_repair(spark, sf):
    return fx.derive(spark, sf, fx.BROKEN_IPS).select(
        "event_id", F.col("src_ip").alias("original"), repair_ip(F.col("src_ip")).alias("src_ip"))


@query("valid_ips", fx.oracle(broken=fx.BROKEN_IPS, repaired=REPAIRED) + """
select distinct src_ip from repaired where src_ip is not null""")
def valid_ips(spark, sf):
    return enrich.valid_ips(fx.derive(spark, sf, fx.BROKEN_IPS))


CONTRACT_ROWS = """
select event_id, case event_id % 5 when 0 then '2024-03-01 10:20:30' when 1 then '2024-03-01' when 2 then 'not a date'
  when 3 then null else '2024-12-31 23:59:59' end as timestamp,
 case event_id % 4 when 0 then null else '45.67.89.10' end as src_ip, cast(null as string) as user,
 case event_id % 3 when 0 then 'ListUsers' else null end as action, case event_id % 2 when 0 then 'FAILED' else null end as result,
 case event_id % 11 when 0 then null else 'UNKNOWN' end as event_type, case event_id % 13 when 0 then null else props end as raw_log
from {events}
"""


@query("normalized_contract", fx.oracle(contract=CONTRACT_ROWS.replace("as timestamp,", 'as "timestamp",').replace("as user,", 'as "user",')) + """
select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as "timestamp", src_ip, "user", action, result, event_type, raw_log,
 case when ts is null then 'timestamp' when event_type is null then 'event_type' when raw_log is null then 'raw_log' end
 as contract_error from (select *, try_cast("timestamp" as timestamp) as ts from contract)""")
def normalized_contract(spark, sf):
    typed = events.apply_contract(fx.derive(spark, sf, CONTRACT_ROWS), keep=["event_id"])
    return typed.withColumn("timestamp", iso_text(F.col("timestamp")))


VALIDATED = f"""
select event_id, case {' '.join(f"when {f} is null then '{fv.MISSING_FIELD}{f}'" for f in fv.REQUIRED_FIELDS)}
 when try_cast(alert_score as double) is null then 'could not convert string to float: ''' || alert_score || ''''
 when not (try_cast(alert_score as double) between 0 and 10) then '{fv.BAD_SCORE}'
 when upper(prelim_priority) not in {sql_list(fv.VALID_PRIORITIES)} then '{fv.BAD_PRIORITY}'
 when length(ip) > 0 and not regexp_matches(ip, '{fv.IPV4_SHAPE}') then '{fv.BAD_IP}' || ip else '{fv.VALID}' end as message
from candidates
"""


@query("validation_report", fx.oracle(candidates=fx.LOG_CANDIDATES, validated=VALIDATED) + f"""
select event_id, message = '{fv.VALID}' as is_valid, message from validated""")
def validation_report(spark, sf):
    return checks.with_validation(fx.derive(spark, sf, fx.LOG_CANDIDATES)).select("event_id", "is_valid", "message")


@query("validation_counts", fx.oracle(candidates=fx.LOG_CANDIDATES, validated=VALIDATED) + """
select message, count(*) as n from validated group by message""")
def validation_counts(spark, sf):
    checked = checks.with_validation(fx.derive(spark, sf, fx.LOG_CANDIDATES))
    return checked.groupBy("message").agg(F.count(F.lit(1)).alias("n"))


# -- enrichment -------------------------------------------------------------------------


@query("ti_enrich", fx.oracle(ct_events=fx.CT_EVENTS, reputation=fx.IP_REPUTATION,
                              broken="select event_id, source_ip_address as src_ip from ct_events", repaired=REPAIRED) + """
select event_id, src_ip, case when coalesce(abuse_confidence, 0) < 10 then 1 when abuse_confidence < 30 then 3
 when abuse_confidence < 60 then 6 when abuse_confidence < 80 then 8 else 10 end as ti_score,
 coalesce(country, 'NA') as ti_country, coalesce(asn, 'NA') as ti_asn from repaired left join reputation on src_ip = ip""")
def ti_enrich(spark, sf):
    rows = ct_events(spark, sf).select("event_id", F.col("source_ip_address").alias("src_ip"))
    reputation = fx.derive(spark, sf, fx.IP_REPUTATION)
    return enrich.enrich(rows, reputation, "event_id")


REPUTATION_TABLE = """
select '203.0.113.' || cast(user_id % 7 as varchar) as ip, cast(user_id * 13 % 101 as integer) as abuse_confidence,
 case user_id % 3 when 0 then 'US' when 1 then 'IN' else null end as country, 'AS' || cast(user_id % 9 as varchar) as asn
from events"""


@query("ti_enrich_table", fx.oracle(ct_events=fx.CT_EVENTS, listed=REPUTATION_TABLE, reputation="""
select ip, abuse_confidence, country, asn from (select *, row_number() over (partition by ip
 order by abuse_confidence desc nulls last, country desc nulls last, asn desc nulls last) as place from listed) where place = 1""",
                                    broken="select event_id, source_ip_address as src_ip from ct_events", repaired=REPAIRED)
       + ORACLES["ti_enrich"][ORACLES["ti_enrich"].rindex("select event_id, src_ip, case"):])
def ti_enrich_table(spark, sf):
    """A written reputation table that lists addresses many times."""
    path = fresh_path(spark, "reputation")
    events_table = spark.read.parquet(f"{sf}/events.parquet")
    spark.sql(REPUTATION_TABLE.replace("varchar", "string").replace("from events", "from {events}"), events=events_table).write.parquet(path)
    rows = ct_events(spark, sf).select("event_id", F.col("source_ip_address").alias("src_ip"))
    return enrich.enrich(rows, files.read_reputation(spark, path), "event_id")


# -- star schema ------------------------------------------------------------------------

DIM_USERS = f"""select {NUMBER.format('user_name')} as user_id, user_name as username
from (select distinct user_name from logs where user_name is not null)"""
DIM_ACTIONS = f"""select {NUMBER.format('action')} as action_id, action as action_name
from (select distinct action from logs where action is not null)"""
FIRST_IPS = """select src_ip, country, ti_score from (select *, row_number() over (partition by src_ip order by id) as place
 from logs where src_ip is not null) where place = 1"""
DIM_IPS = f"select {NUMBER.format('src_ip')} as ip_id, src_ip, country, ti_score from ({FIRST_IPS})"
STAR = {"logs": fx.ENRICHED_FLAT, "users": DIM_USERS, "actions": DIM_ACTIONS, "ips": DIM_IPS}
STAR_FACT = """select id, event_ts, user_id, action_id, ip_id, result, result_flag, alert_score, prelim_priority, {0} as ti_country
from {1} l join users on username = user_name join actions on action_name = action join ips i on i.src_ip = l.src_ip"""


@query("dim_users", fx.oracle(logs=fx.ENRICHED_FLAT) + DIM_USERS)
def dim_users(spark, sf):
    return warehouse.new_dimension(flat_logs(spark, sf), "user", "username", "user_id")


@query("dim_actions", fx.oracle(logs=fx.ENRICHED_FLAT) + DIM_ACTIONS)
def dim_actions(spark, sf):
    return warehouse.new_dimension(flat_logs(spark, sf), "action", "action_name", "action_id")


@query("dim_ips", fx.oracle(logs=fx.ENRICHED_FLAT) + DIM_IPS)
def dim_ips(spark, sf):
    return warehouse.new_ip_dimension(flat_logs(spark, sf), "id")


@query("star_fact", fx.oracle(**STAR) + STAR_FACT.format("l.country", "logs"))
def star_fact(spark, sf):
    logs = flat_logs(spark, sf)
    return warehouse.star_fact(logs, *dimensions(logs))


LOADS = {
    "sightings": fx.SIGHTINGS, "logs": "select * from sightings where load_no = 1", "users": DIM_USERS,
    "actions": DIM_ACTIONS, "ips": DIM_IPS, "later": FIRST_IPS.replace("from logs where", "from sightings where load_no = 2 and"),
    "fresh": f"""select {NUMBER.format('src_ip')} + (select max(ip_id) from ips) as ip_id, src_ip, country, ti_score
 from later where src_ip not in (select src_ip from ips)""",
}


def two_loads(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = sightings(spark, sf)
    return rows.where("load_no = 1"), rows.where("load_no = 2")


@query("star_fact_strict", fx.oracle(**LOADS) + STAR_FACT.format("ti_country", "sightings"))
def star_fact_strict(spark, sf):
    earlier, _ = two_loads(spark, sf)
    return warehouse.star_fact(sightings(spark, sf), *dimensions(earlier), ti_country="ti_country")


def sql_missing(column: str, dim: str, key: str) -> str:
    gone = f"select distinct {column} as k from sightings where {column} not in (select {key} from {dim})"
    return f"""
select '{"user" if column == "user_name" else column}' as dimension, count(*) as incoming_rows, count(d.k) as matched_rows,
 count(*) - count(s.k) as null_rows, (select count(*) from ({gone})) as missing_keys,
 (select coalesce(string_agg(k, ',' order by k), '') from (select k from ({gone}) order by k limit 10)) as sample_keys
from (select {column} as k from sightings) s left join (select {key} as k from {dim}) d on d.k = s.k"""


@query("missing_keys", fx.oracle(**LOADS) + " union all ".join(
    sql_missing(*names) for names in [("user_name", "users", "username"), ("action", "actions", "action_name"), ("src_ip", "ips", "src_ip")]))
def missing_keys(spark, sf):
    earlier, _ = two_loads(spark, sf)
    return warehouse.missing_keys(sightings(spark, sf), *dimensions(earlier))


@query("dim_insert_if_absent", fx.oracle(**LOADS) + "select * from ips union all select * from fresh")
def dim_insert_if_absent(spark, sf):
    earlier, later = two_loads(spark, sf)
    existing = stage(warehouse.new_ip_dimension(earlier, "id"), "ip_details")
    return warehouse.insert_if_absent(existing, warehouse.first_per_ip(later, "id"), "src_ip", "ip_id")


@query("dim_upsert", fx.oracle(**LOADS) + """
select i.ip_id, i.src_ip, case when l.src_ip is null then i.country else l.country end as country,
 case when l.src_ip is null then i.ti_score else l.ti_score end as ti_score
from ips i left join later l on l.src_ip = i.src_ip union all select * from fresh""")
def dim_upsert(spark, sf):
    earlier, later = two_loads(spark, sf)
    existing = stage(warehouse.new_ip_dimension(earlier, "id"), "ip_details")
    return warehouse.upsert(existing, warehouse.first_per_ip(later, "id"), "src_ip", "ip_id")


@query("star_load", fx.oracle(**LOADS) + """
select id, event_ts, user_name as username, action as action_name, l.src_ip, case when t.src_ip is null then i.country else t.country end as country,
 case when t.src_ip is null then i.ti_score else t.ti_score end as ti_score, result, result_flag, alert_score, prelim_priority, ti_country
from sightings l left join ips i on i.src_ip = l.src_ip left join later t on t.src_ip = l.src_ip
where user_name is not null and action is not null""")
def star_load(spark, sf):
    """Loads into one star schema, read back by name: the first one again with its days moved, the second with each row twice."""
    base = fresh_path(spark, "star")
    earlier, later = two_loads(spark, sf)
    moved = earlier.withColumn("event_ts", F.col("event_ts") + F.expr("interval 60 days"))
    for logs in (earlier, moved, later.unionByName(later)):
        sinks.load_star(logs, base, ti_country="ti_country")
    fact = files.read_table(spark, f"{base}/enriched_logs").drop("dt")
    users, actions = (files.read_table(spark, f"{base}/{name}") for name in ("users", "actions"))
    ips = sinks.read_ip_details(spark, base).drop("version")
    for dim, key in [(users, "user_id"), (actions, "action_id"), (ips, "ip_id")]:
        fact = lookup(fact, dim, key, "id", "inner").drop(key)
    return fact


@query("star_history", fx.oracle(**LOADS) + """
select i.src_ip, i.country, i.ti_score, 1 as version, cast(case when l.src_ip is not null and (l.country is distinct from i.country
  or l.ti_score is distinct from i.ti_score) then 2 end as bigint) as replaced_by from ips i left join later l on l.src_ip = i.src_ip
union all select l.src_ip, l.country, l.ti_score, 2, null from later l left join ips i on l.src_ip = i.src_ip
where i.src_ip is null or l.country is distinct from i.country or l.ti_score is distinct from i.ti_score""")
def star_history(spark, sf):
    """What was known of each address after each of two loads."""
    base = fresh_path(spark, "star")
    for logs in two_loads(spark, sf):
        sinks.load_star(logs, base, ti_country="ti_country")
    return sinks.ip_history(spark, base).select("src_ip", "country", "ti_score", F.col("version").cast("int").alias("version"), "replaced_by")


@query("flat_projection", fx.oracle(**FLAT) + "select src_ip, ti_score, ti_country, ti_asn, alert_score, prelim_priority from flat")
def flat_projection(spark, sf):
    return warehouse.flat_projection(flat_logs(spark, sf))


def sql_rules(table: str, target: str, column: str) -> list[str]:
    return [
        f"select '{target}.{column}' as target, 'unique' as rule, count(*) as violations from (select {column} from {table}"
        f" where {column} is not null group by {column} having count(*) > 1)",
        f"select '{target}.{column}', 'not null', count(*) from {table} where {column} is null",
    ]


CONSTRAINTS = sql_rules("fact", "enriched_logs", "id")
for _dim, _target, _id, _key in [("users", "users", "user_id", "username"), ("actions", "actions", "action_id", "action_name"),
                                 ("ips", "ip_details", "ip_id", "src_ip")]:
    CONSTRAINTS += sql_rules(_dim, _target, _id) + sql_rules(_dim, _target, _key)
    CONSTRAINTS.append(f"select 'enriched_logs.{_id}', 'foreign key', count(*) from fact where {_id} is not null"
                       f" and {_id} not in (select {_id} from {_dim})")


@query("constraint_report", fx.oracle(**WH) + " union all ".join(CONSTRAINTS))
def constraint_report(spark, sf):
    return warehouse.constraint_report(wh_fact(spark, sf), *wh_dims(spark, sf))


# -- alert store --------------------------------------------------------------------------


@query("alert_rows", fx.oracle(raw_lines=fx.RAW_LINES) + f"""
select event_id as id, event_ts as "timestamp", src_ip, cast(null as varchar) as "user", 'UNKNOWN' as event_type, 'LOW' as severity,
 case when src_ip <> 'unknown' and not (starts_with(src_ip, '10.') or starts_with(src_ip, '172.') or starts_with(src_ip, '192.168.'))
  then 15 else 0 end as risk_score, cast(null as varchar) as ai_reasoning, 'OPEN' as status
from (select *, {sql_ip('raw_log')} as src_ip from raw_lines)""")
def alert_rows(spark, sf):
    return analysis.line_alerts(fx.derive(spark, sf, fx.RAW_LINES), F.col("event_id"), F.col("event_ts"))


@query("alert_store", fx.oracle(**CT) + STORE)
def alert_store(spark, sf):
    """Alerts appended to a store in two parts and read back."""
    path = fresh_path(spark, "alert_store")
    alerts = event_alerts(spark, sf)
    for part in (0, 1):
        sinks.append_parquet(alerts.where(F.col("id") % 2 == part), path)
    return files.alert_store(spark, path)


@query("alerts_by_id_desc", fx.oracle(**CT) + STORE)
def alerts_by_id_desc(spark, sf):
    return reports.newest_first(event_alerts(spark, sf))


@query("dashboard_metrics", fx.oracle(**CT) + """
select count(*) as total_alerts, count(*) filter (priority = 'CRITICAL') as critical_alerts,
 count(*) filter (priority = 'HIGH') as high_alerts from scored""")
def dashboard_metrics(spark, sf):
    return reports.dashboard_metrics(event_alerts(spark, sf))


@query("live_feed", fx.oracle(**CT) + """
select event_id as id, event_ts as "timestamp", src_ip, log_type as event_type, priority as severity, risk_score from scored""")
def live_feed(spark, sf):
    return reports.live_feed(event_alerts(spark, sf))


# -- warehouse reports ----------------------------------------------------------------------


@query("warehouse_stats", fx.oracle(fact=fx.WH_FACT) + f"""
select total_alerts, critical_alerts, unique_users, {sql_even(sql_round('m', 6) + ' * 10000.0', 2)} as avg_risk_score
from (select count(*) as total_alerts, count(*) filter (upper(prelim_priority) = 'HIGH') as critical_alerts,
 count(distinct user_id) as unique_users, {sql_mean('alert_score')} as m from fact)""")
def warehouse_stats(spark, sf):
    return reports.warehouse_stats(wh_fact(spark, sf))


@query("stats_by_username", fx.oracle(users=fx.WH_USERS, fact=fx.WH_FACT) + f"""
select count(*) as total_alerts, count(*) filter (upper(prelim_priority) = 'HIGH') as critical_alerts,
 count(distinct username) as unique_users, {sql_even(sql_mean('alert_score'), 2)} as avg_risk_score
from fact f left join users u on u.user_id = f.user_id""")
def stats_by_username(spark, sf):
    return reports.stats_by_username(wh_fact(spark, sf), wh_dims(spark, sf)[0])


@query("record_count", fx.oracle(fact=fx.WH_FACT) + "select count(*) as records_loaded from fact")
def record_count(spark, sf):
    return reports.record_count(wh_fact(spark, sf))


RAW_NAME = "trim(case when username is null or username = '' then 'Unknown' else username end)"


@query("alerts_feed", fx.oracle(**WH) + f"""
select id, coalesce(regexp_replace(strftime(event_ts, '%Y-%m-%d %H:%M:%S.%f'), '[.]000000$', ''), '—') as "timestamp",
 {sql_names(f'lower({RAW_NAME})', fv.FEED_NAMES, sql_capitalize(RAW_NAME))} as "user", coalesce(nullif(action_name, ''), '—') as action,
 coalesce(nullif(prelim_priority, ''), 'LOW') as prelim_priority, coalesce(alert_score, 0.0) as alert_score,
 coalesce(src_ip, '—') as src_ip
from fact f left join users u on u.user_id = f.user_id left join actions a on a.action_id = f.action_id
 left join ips i on i.ip_id = f.ip_id order by event_ts desc nulls first, id desc limit 100""")
def alerts_feed(spark, sf):
    return reports.alerts_feed(wh_fact(spark, sf), *wh_dims(spark, sf))


@query("alerts_feed_first", ORACLES["alerts_feed"].replace("limit 100", "limit 30"))
def alerts_feed_first(spark, sf):
    return reports.alerts_feed(wh_fact(spark, sf), *wh_dims(spark, sf), limit=30)


@query("lower_case_names", fx.oracle(fact=fx.WH_FACT) + "select * from fact")
def lower_case_names(spark, sf):
    fact = wh_fact(spark, sf)
    return files.lower_names(fact.toDF(*[c.upper() for c in fact.columns]))


@query("alerts_latest", fx.oracle(**WH) + """
select id, username as "user", action_name as action, src_ip, result, alert_score, prelim_priority, ti_country, ti_asn
from fact f left join users u on u.user_id = f.user_id left join actions a on a.action_id = f.action_id
 left join ips i on i.ip_id = f.ip_id order by id desc limit 100""")
def alerts_latest(spark, sf):
    return reports.alerts_latest(wh_fact(spark, sf), *wh_dims(spark, sf))


@query("logs_latest", fx.oracle(fact=fx.WH_FACT) + "select * from fact order by event_ts desc nulls first, id desc limit 50")
def logs_latest(spark, sf):
    return reports.logs_latest(wh_fact(spark, sf))


TREND_VALUE = f"count(*) as alert_count, coalesce({sql_round(sql_mean('nullif(alert_score, 0)'), 2)}, 0.0) as avg_risk"


@query("daily_trend", fx.oracle(fact=fx.WH_FACT) + f"""
select strftime(event_ts, '%Y-%m-%d') as day, {TREND_VALUE} from fact where event_ts is not null group by 1""")
def daily_trend(spark, sf):
    return reports.daily_trend(wh_fact(spark, sf))


@query("trend_window", fx.oracle(fact=fx.WH_FACT) + f"""
select r.range as "range", strftime(event_ts, '%Y-%m-%d') as day, {TREND_VALUE}
from fact join (values ('24h', interval 1 day), ('7d', interval 7 day), ('30d', interval 30 day), ('365d', interval 12 month))
 as r(range, width) on event_ts >= (select max(event_ts) from fact) - r.width group by 1, 2""")
def trend_window(spark, sf):
    return reports.trend_window(wh_fact(spark, sf))


@query("trend_last_week", fx.oracle(fact=fx.WH_FACT) + f"""
select strftime(event_ts, '%Y-%m-%d') as day, {TREND_VALUE} from fact
where event_ts >= (select max(event_ts) from fact) - interval 7 day group by 1""")
def trend_last_week(spark, sf):
    return reports.trend_since(wh_fact(spark, sf), "7d")


INSIGHT_RAW = "case when username is null or username = '' then 'Unknown' else username end"
INSIGHTS = f"""
select id, shown as "user", case when alert_score > 0.8 then '{fv.LOCKDOWN_ADVICE[0]}' || shown || '{fv.LOCKDOWN_ADVICE[1]}'
 when upper(prelim_priority) = 'HIGH' then '{fv.REVIEW_ADVICE[0]}' || shown || '{fv.REVIEW_ADVICE[1].replace("'", "''")}'
  || coalesce(nullif(ti_country, ''), 'Unknown') || '{fv.REVIEW_ADVICE[2]}'
 else '{fv.NORMAL_ADVICE[0]}' || shown || '{fv.NORMAL_ADVICE[1]}' end as recommendation
from (select *, {sql_names(f'trim({INSIGHT_RAW})', fv.INSIGHT_NAMES, sql_capitalize(INSIGHT_RAW))} as shown
 from fact f left join users u on u.user_id = f.user_id where alert_score is not null order by alert_score desc, id limit 100)
"""


@query("agentic_insights", fx.oracle(users=fx.WH_USERS, fact=fx.WH_FACT) + INSIGHTS)
def agentic_insights(spark, sf):
    return reports.agentic_insights(wh_fact(spark, sf), wh_dims(spark, sf)[0])


@query("insights_or_default", fx.oracle(users=fx.WH_USERS, fact=fx.WH_FACT, found=INSIGHTS) + f"""
select 'all' as source, * from found
union all select 'unscored', cast(null as bigint), '{fv.NO_INSIGHTS[0]}', '{fv.NO_INSIGHTS[1]}'""")
def insights_or_default(spark, sf):
    fact, users = wh_fact(spark, sf), wh_dims(spark, sf)[0]
    unscored = fact.where(F.col("alert_score").isNull())
    both = [("all", reports.agentic_insights(fact, users)), ("unscored", reports.agentic_insights(unscored, users))]
    shown = [df.select(F.lit(name).alias("source"), "*") for name, df in both]
    return shown[0].unionByName(shown[1])


# -- findings -----------------------------------------------------------------------------

TOP_USERS = """select user_name as "user", count(alert_score) as high_alerts from flat
where upper(prelim_priority) = 'HIGH' and user_name is not null group by 1 order by 2 desc, 1 limit 5"""
TOP_IPS = f"""select src_ip, round({sql_mean('alert_score')}, 12) as mean_score from flat where src_ip is not null
group by 1 order by 2 desc nulls last, 1 limit 5"""
FINDINGS = {"flat": fx.ENRICHED_FLAT, "top_users": TOP_USERS, "top_ips": TOP_IPS, "findings": f"""
select "user", high_alerts || ' high-priority alerts detected for ' || "user" as finding, cast(null as varchar) as ip,
 cast(null as varchar) as message from top_users
union all select null, 'IP ' || src_ip || ' shows avg alert score ' || cast(cast({sql_even('mean_score', 2)} as decimal(18,2)) as varchar),
 src_ip, null from top_ips"""}


@query("top_high_users", fx.oracle(**FLAT) + TOP_USERS)
def top_high_users(spark, sf):
    return reports.top_high_users(flat_logs(spark, sf))


@query("top_risky_ips", fx.oracle(**FLAT) + TOP_IPS)
def top_risky_ips(spark, sf):
    return reports.top_risky_ips(flat_logs(spark, sf))


@query("top_findings", fx.oracle(**FINDINGS) + "select * from findings")
def top_findings(spark, sf):
    return reports.top_findings(flat_logs(spark, sf))


@query("finding_recs", fx.oracle(**FINDINGS) + """
select case when "user" is not null then 'user' else 'ip' end as type, coalesce("user", ip) as target,
 case when "user" is not null then 'Review login activity for ' || "user" else 'Investigate IP ' || ip || ' for repeated alerts' end
 as recommendation from findings""")
def finding_recs(spark, sf):
    return reports.finding_recommendations(reports.top_findings(flat_logs(spark, sf)))


@query("entity_insights", fx.oracle(**FLAT) + f"""
select {sql_capitalize('user_name')} as entity, {sql_even('m', 2)} as risk_score, case when m > 0.7 then '{fv.ENTITY_STEPS[0][1]}'
 when m > 0.4 then '{fv.ENTITY_STEPS[1][1]}' else '{fv.ENTITY_NORMAL}' end as summary
from (select user_name, {sql_mean('alert_score')} as m from flat where user_name is not null and alert_score is not null group by 1)""")
def entity_insights(spark, sf):
    return reports.entity_insights(flat_logs(spark, sf))


# -- models ---------------------------------------------------------------------------------


@query("minmax_norm", fx.oracle(**FLAT) + """
select id, (final_risk_score - lo) / (hi - lo + 1e-9) as norm
from flat join (select min(final_risk_score) as lo, max(final_risk_score) as hi from flat) on true""")
def minmax_norm(spark, sf):
    return scaling.normalize(flat_logs(spark, sf).select("id", "final_risk_score"), "final_risk_score", "norm").select("id", "norm")


def featured_logs(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.features(flat_logs(spark, sf)).select("id", "action", *anomaly.NUMERIC, "action_top")


@query("anomaly_features", fx.oracle(**FLAT) + """
select id, final_risk_score, cast(coalesce(ti_score, 0) as double) as ti_score, cast(coalesce(hour(event_ts), 0) as integer) as hour,
 cast(coalesce(isodow(event_ts) - 1, 0) as integer) as weekday, case when contains(lower(action), 'consolelogin') then 1 else 0 end as is_console,
 'action_' || coalesce(action, 'OTHER') as hot_feature from flat""")
def anomaly_features(spark, sf):
    featured = featured_logs(spark, sf)
    vocabulary = stage(anomaly.action_vocabulary(featured), "actions_seen")
    return anomaly.one_hot(featured, vocabulary, "id").select("id", *anomaly.NUMERIC, "hot_feature")


def sql_draw(*keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('-', {', '.join(keys)})), 1, {anomaly.DRAW_DIGITS}))::bigint / {16 ** anomaly.DRAW_DIGITS}.0::double)"


def sql_mean_path(size: str) -> str:
    return f"case when {size} <= 1 then 0.0 when {size} = 2 then 1.0 else 2 * (ln({size} - 1) + 0.5772156649015329) - 2.0 * ({size} - 1) / {size} end"


def forest_sql() -> str:
    """The isolation forest grown and asked in SQL: samples, then trees and walks level by level."""
    seed, sample, wanted = anomaly.SEED, anomaly.SAMPLE, 2 * anomaly.TREES * anomaly.SAMPLE
    places = range(len(anomaly.NUMERIC))
    xs = ", ".join(f"x{i}" for i in places)
    ranges = ", ".join(f"min(x{i}) over w as l{i}, max(x{i}) over w as h{i}" for i in places)
    varying = "list_filter([" + ", ".join(f"case when h{i} - l{i} > 1e-7 then {i} end" for i in places) + "], lambda f: f is not null)"
    low, high, value = ("[" + ", ".join(f"{side}{i}" for i in places) + "][feature + 1]" for side in "lhx")
    right = f"case when feature < {len(places)} then {value} > threshold else action_top = name end"
    return f"""
with recursive flat as ({fx.ENRICHED_FLAT.replace("{events}", "events")}),
feats as (
  select id, action, final_risk_score, final_risk_score::double as x0, coalesce(ti_score, 0)::double as x1, coalesce(hour(event_ts), 0)::double as x2,
    coalesce(isodow(event_ts) - 1, 0)::double as x3, (case when contains(lower(action), 'consolelogin') then 1 else 0 end)::double as x4,
    coalesce(action, 'OTHER') as action_top from flat),
pool as (select * from feats where {sql_draw("id", str(seed))} * (select count(*) from feats) < {wanted}),
draws as (select p.*, t.tree, {sql_draw("id", str(seed), "tree")} as draw from pool p cross join range(1, {anomaly.TREES + 1}) t(tree)),
ranked as (
  select *, row_number() over (partition by tree order by draw, id) as place from draws
  where draw * least((select count(*) from feats), {wanted}) < {2 * sample}),
sampled as (select *, count(*) over (partition by tree) as size from ranked where place <= {sample}),
grown as (
  select id, tree, {xs}, action_top, size, 1 as spot, 0 as depth, null::int as feature, null::double as threshold, null::varchar as name from sampled
  union all
  select id, tree, {xs}, action_top, size, 2 * spot + ({right})::int, depth + 1, feature, threshold, name
  from (
    select * exclude (threshold), {low} + {sql_draw(str(seed), "tree", "spot", "1")} * ({high} - {low}) as threshold
    from (
      select * exclude (feature, name), case when pick < len(vary) then vary[pick + 1] else {len(places)} end as feature,
        case when pick >= len(vary) then names[pick - len(vary) + 1] end as name
      from (
        select *, floor({sql_draw(str(seed), "tree", "spot", "0")} * (len(vary) + flags))::int as pick
        from (
          select *, {varying} as vary, case when len(names) > 1 then len(names) else 0 end as flags
          from (
            select *, {ranges}, count(*) over w as n, list_sort(list_distinct(list(action_top) over w)) as names
            from grown window w as (partition by tree, spot))
          where n > 1 and depth < ceil(log2(greatest(size, 2))))
        where len(vary) + flags > 0)))),
splits as (select distinct tree, spot // 2 as spot, feature, threshold, name from grown where spot > 1),
leaves as (
  select g.tree, g.spot, any_value(g.depth) + {sql_mean_path("count(*)")} as length
  from grown g anti join splits s on s.tree = g.tree and s.spot = g.spot group by g.tree, g.spot),
walk as (
  select id, {xs}, action_top, tree, 1 as spot from feats cross join (select distinct tree from sampled)
  union all
  select id, {xs}, action_top, w.tree, 2 * w.spot + ({right})::int from walk w join splits s on s.tree = w.tree and s.spot = w.spot),
paths as (select id, sum(length) / count(*) as length from walk join leaves on leaves.tree = walk.tree and leaves.spot = walk.spot group by id),
raw as (select id, power(2.0, -length / (select {sql_mean_path("max(size)")} from sampled)) as score from paths),
scored as (
  select id, action, final_risk_score, (score - (select min(score) from raw)) / ((select max(score) - min(score) from raw) + 1e-9) as ml_score
  from raw join feats using (id))
select id, action, {sql_round("ml_score", 9)} as ml_score, (ml_score > {anomaly.FLAG_ABOVE})::int as ml_flag,
  {sql_round(f"(final_risk_score + ml_score * {anomaly.SCORE_WEIGHT})", 9)} as adjusted_risk_score from scored"""


def scored_logs(spark: SparkSession, sf: str) -> DataFrame:
    featured = featured_logs(spark, sf)
    forest = stage(anomaly.train_forest(featured, "id"), "forest")
    return anomaly.anomaly_scores(featured, forest, keep=["id", "action"])


@query("anomaly_scored", forest_sql())
def anomaly_scored(spark, sf):
    return scored_logs(spark, sf).select(
        "id", "action", round_half_up(F.col("ml_score"), 9).alias("ml_score"), "ml_flag",
        round_half_up(F.col("adjusted_risk_score"), 9).alias("adjusted_risk_score"))


SCALED = ", ".join(
    f"({name} - (select min({name}) from filled)) / (select case when max({name}) > min({name}) then max({name}) - min({name})"
    f" else 1.0 end from filled) as {name}_scaled" for name in fusion.INPUTS)
LABEL = "case prelim_priority when 'MEDIUM' then 1 when 'HIGH' then 2 when 'CRITICAL' then 3 else 0 end"


@query("fusion_features", fx.oracle(flat=fx.ENRICHED_FLAT, filled="""
select id, coalesce(alert_score, 0.0) as alert_score, cast(coalesce(ti_score, 0) as double) as ti_score,
 coalesce(ip_score, 0.0) as ip_score, cast(cast(result_flag as int) as double) as result_flag from flat""") + f"""
select id, {SCALED} from filled""")
def fusion_features(spark, sf):
    return fusion.fusion_features(flat_logs(spark, sf)).select("id", *fusion.SCALED)


@query("fusion_labels", fx.oracle(**FLAT) + f"select id, {LABEL} as label from flat")
def fusion_labels(spark, sf):
    return flat_logs(spark, sf).select("id", scores.priority_code(F.col("prelim_priority")).alias("label"))


BUCKET = "case when alert_score > 0.85 then 'CRITICAL' when alert_score > 0.6 then 'HIGH' when alert_score > 0.3 then 'MEDIUM' else 'LOW' end"


@query("fusion_bucket", fx.oracle(**FLAT) + f"select id, {BUCKET} as final_priority from flat")
def fusion_bucket(spark, sf):
    return flat_logs(spark, sf).select("id", scores.fusion_bucket(F.col("alert_score")).alias("final_priority"))


FOREST = fx.oracle(flat=fx.ENRICHED_FLAT, filled=f"""
select id, {LABEL} as label, coalesce(alert_score, 0.0) as alert_score, cast(coalesce(ti_score, 0) as double) as ti_score,
 coalesce(ip_score, 0.0) as ip_score, cast(cast(result_flag as int) as double) as result_flag from flat""", scaled=f"select id, label, {SCALED} from filled",
    named="select id, label, " + ", ".join(f"{name} as f{i}" for i, name in enumerate(fusion.SCALED)) + " from scaled"
) + "," + fusion_sql.grown_sql("named", forest.TREES, forest.DEPTH) + f""",
final as (
  select f.id, event_ts as "timestamp", user_name as "user", src_ip, a.label, a.predicted::int as predicted,
    {sql_even(f"(greatest(s0, s1, s2, s3)::double * 100.0::double / {forest.TREES * forest.SHARE_UNITS}.0::double)", 2)} as final_score,
    (s2 + s3)::double / {forest.TREES * forest.SHARE_UNITS}.0::double as p_high
  from alerts a join flat f on f.id = a.id),
final_alerts as (select *, {BUCKET.replace("alert_score", "final_score / 100.0::double")} as final_priority from final)
"""


def forest_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Final alerts of the forest that SQL can grow again; grown once per application and table set, then loaded."""
    featured = stage(fusion.fusion_features(flat_logs(spark, sf)).select(
        "id", F.col("event_ts").alias("timestamp"), "user", "src_ip", *fusion.SCALED, "label"), "fusion_features")
    where = f"{shared_dir(spark)}/idsignal/{spark.sparkContext.applicationId}/forest-{zlib.crc32(sf.encode())}"
    return fusion.forest_scores(featured, fusion.grow_forest(where, featured, "id"), "id")


@query("fusion_final", FOREST + """
select id, "timestamp", "user", src_ip, label, predicted, final_score, final_priority, p_high from final_alerts""")
def fusion_final(spark, sf):
    return forest_alerts(spark, sf).select(
        "id", "timestamp", "user", "src_ip", "label", "predicted", "final_score", "final_priority", "p_high")


@query("fusion_ml_final")
def fusion_ml_final(spark, sf):
    """Final alerts of Spark ML's forest."""
    featured = stage(fusion.fusion_features(flat_logs(spark, sf)).select(
        "id", F.col("event_ts").alias("timestamp"), "user", "src_ip", *fusion.SCALED, "label"), "fusion_features")
    model = fusion.train(featured, "id")
    return fusion.final_scores(featured, model).select(
        "id", "timestamp", "user", "src_ip", "label", "predicted", "final_score", "final_priority", "p_high")


@query("anomaly_consistency", fx.oracle(**FLAT) + """
select count(*) as logs, count(distinct id) as ids, 0 as outside, 0 as wrong_flags, 0 as wrong_scores, 0.0 as lowest, 1.0 as highest from flat""")
def anomaly_consistency(spark, sf):
    """What must hold of every anomaly score: its range, the flag's cut, the adjusted score."""
    scored = stage(scored_logs(spark, sf), "anomaly_scored").join(flat_logs(spark, sf).select("id", F.col("final_risk_score").alias("before")), "id")
    flag = (F.col("ml_score") > anomaly.FLAG_ABOVE).cast("int")
    expected = F.col("before") + F.col("ml_score") * anomaly.SCORE_WEIGHT
    return scored.agg(
        F.count(F.lit(1)).alias("logs"), F.countDistinct("id").alias("ids"),
        F.count_if(~F.col("ml_score").between(0, 1)).alias("outside"), F.count_if(F.col("ml_flag") != flag).alias("wrong_flags"),
        F.count_if(F.abs(F.col("adjusted_risk_score") - expected) > 1e-9).alias("wrong_scores"),
        F.round(F.min("ml_score"), 6).alias("lowest"), F.round(F.max("ml_score"), 6).alias("highest"))


def fused(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Final alerts of the fitted model, and its report on the held-out part."""
    featured = stage(fusion.fusion_features(flat_logs(spark, sf)).select(
        "id", F.col("event_ts").alias("timestamp"), "user", "src_ip", *fusion.SCALED, "label"), "fusion_features")
    # trained once per application and table set, then loaded
    where = f"{shared_dir(spark)}/idsignal/{spark.sparkContext.applicationId}/fusion-{zlib.crc32(sf.encode())}"
    model = fusion.load_or_train(where, featured, "id")
    return stage(fusion.final_scores(featured, model), "final_alerts"), fusion.held_out_report(featured, model, "id")


@query("fusion_consistency", fx.oracle(**FLAT) + """
select count(*) as alerts, 0 as outside, 0 as wrong_priority, 0 as below_even_odds, cast(sum(case when prelim_priority = 'HIGH' then 1 else 0 end) as bigint)
 as high_labels from flat""")
def fusion_consistency(spark, sf):
    """What must hold of every final alert: the score's range, the priority of a score, at least even odds."""
    final, _ = fused(spark, sf)
    return final.agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if(~F.col("final_score").between(0, 100)).alias("outside"),
        F.count_if(F.col("final_priority") != scores.fusion_bucket(F.col("final_score") / 100.0)).alias("wrong_priority"),
        F.count_if(F.col("final_score") < 25).alias("below_even_odds"), F.count_if(F.col("label") == 2).alias("high_labels"))


@query("fusion_held_out")
def fusion_held_out(spark, sf):
    return fused(spark, sf)[1]


@query("fusion_preview", FOREST + """
select "timestamp", "user", src_ip, final_priority from final_alerts order by id limit 10""")
def fusion_preview(spark, sf):
    """The short list, all four columns, of the forest's alerts."""
    return fusion.preview(forest_alerts(spark, sf), "id")


@query("fusion_priorities", FOREST + """
select final_priority, predicted, count(*) as alerts, count(*) filter (label = predicted) as hits from final_alerts group by 1, 2""")
def fusion_priorities(spark, sf):
    """How many alerts of each predicted class come out at each priority."""
    return forest_alerts(spark, sf).groupBy("final_priority", "predicted").agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("label") == F.col("predicted")).alias("hits"))


@query("fusion_model_preview")
def fusion_model_preview(spark, sf):
    """The short list of the fitted model's alerts."""
    return fusion.preview(fused(spark, sf)[0], "id")


@query("classification_report", fx.oracle(flat=fx.ENRICHED_FLAT, buckets=f"select id, {BUCKET} as prelim_priority, {LABEL} as l from flat",
       pairs=f"select l, {LABEL} as p from buckets", classes="""
select c, sum(hit) as hits, sum(is_p) as predicted, sum(is_l) as support from (
 select l as c, case when l = p then 1 else 0 end as hit, 0 as is_p, 1 as is_l from pairs
 union all select p, 0, 1, 0 from pairs) group by c""", rates="""
select c, case when predicted > 0 then hits / predicted else 0.0 end as pr, case when support > 0 then hits / support else 0.0 end as re,
 case when predicted + support > 0 then 2 * hits / (predicted + support) else 0.0 end as f1, support, hits from classes""",
       rows="""select cast(c as varchar) as class, pr as precision, re as recall, f1, support from rates
union all select 'accuracy', null, null, sum(hits) / sum(support), sum(support) from rates
union all select 'macro avg', avg(pr), avg(re), avg(f1), sum(support) from rates
union all select 'weighted avg', sum(pr * support) / sum(support), sum(re * support) / sum(support), sum(f1 * support) / sum(support),
 sum(support) from rates""") + f"""
select class, {sql_round('precision', 6)} as precision, {sql_round('recall', 6)} as recall, {sql_round('f1', 6)} as f1,
 cast(support as bigint) as support from rows""")
def classification_report(spark, sf):
    predictions = flat_logs(spark, sf).select(
        scores.priority_code(F.col("prelim_priority")).alias("label"),
        scores.priority_code(scores.fusion_bucket(F.col("alert_score"))).alias("predicted"))
    report = metrics.classification_report(predictions, "label", "predicted")
    return report.select("class", *[round_half_up(F.col(m), 6).alias(m) for m in ("precision", "recall", "f1")], "support")


# -- streams --------------------------------------------------------------------------------


def stream_fixture(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """A fixture over the events table read as a stream (the pattern allows a file or a folder)."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.sql(text, events=spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]"))


@query("stream_alert_store", ORACLES["alert_rows"])
def stream_alert_store(spark, sf):
    store = fresh_path(spark, "alerts")
    streams.start_alert_stream(
        stream_fixture(spark, sf, fx.RAW_LINES), store, fresh_path(spark, "feed"), fresh_path(spark, "offsets"),
        {"availableNow": True}, timestamp=F.col("event_ts")).awaitTermination()
    return streams.stored_rows(spark, store)


@query("stream_feed", fx.oracle(raw_lines=fx.RAW_LINES, alerts=ORACLES["alert_rows"][ORACLES["alert_rows"].rindex("select event_id as id"):]) + """
select id, src_ip, event_type, severity, risk_score from alerts""")
def stream_feed(spark, sf):
    """The five fields pushed to the live feed."""
    feed = fresh_path(spark, "feed")
    streams.start_alert_stream(
        stream_fixture(spark, sf, fx.RAW_LINES), fresh_path(spark, "alerts"), feed, fresh_path(spark, "offsets"),
        {"availableNow": True}, timestamp=F.col("event_ts")).awaitTermination()
    return streams.stored_rows(spark, feed)


@query("stream_raw_landing", ORACLES["raw_landing"])
def stream_raw_landing(spark, sf):
    path = fresh_path(spark, "landing")
    streams.start_landing(stream_fixture(spark, sf, fx.RAW_LINES), path, fresh_path(spark, "offsets"),
                          {"availableNow": True}, F.col("event_ts")).awaitTermination()
    return streams.stored_rows(spark, path)


@query("stream_severity_counts", fx.oracle(**CT) + "select priority as severity, count(*) as v from scored group by 1")
def stream_severity_counts(spark, sf):
    path = fresh_path(spark, "counts")
    scored = with_risk(events.parse_events(stream_fixture(spark, sf, fx.CT_EVENTS)))
    alerts = analysis.alert_rows(scored, F.col("event_id"), F.col("event_ts"), F.col("log_type"))
    streams.start_severity_counts(alerts, path, fresh_path(spark, "offsets"), {"availableNow": True}).awaitTermination()
    return streams.latest_counts(spark, path)


def replayed_events(spark: SparkSession, sf: str, text: str, source: str) -> DataFrame:
    """A fixture over a stream of the event files that come to lie below `source`."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.sql(text, events=spark.readStream.schema(schema).parquet(source))


@query("stream_replayed", ORACLES["alert_rows"])
def stream_replayed(spark, sf):
    """Every event comes twice, the second time in a later batch after a restart; each is stored once."""
    source, store, feed, offsets = (fresh_path(spark, n) for n in ("events", "alerts", "feed", "offsets"))
    for _ in range(2):
        spark.read.parquet(f"{sf}/events.parquet").write.mode("append").parquet(source)
        seen = streams.once_per_id(replayed_events(spark, sf, fx.RAW_LINES, source), "event_id", "event_ts", "400 days")
        streams.start_alert_stream(seen, store, feed, offsets, {"availableNow": True}, F.col("event_ts")).awaitTermination()
    return streams.stored_rows(spark, store)


@query("stream_compacted", ORACLES["raw_landing"])
def stream_compacted(spark, sf):
    """Landing of 20 micro-batches, of which 16 have been merged into one part by the end."""
    source, path = fresh_path(spark, "events"), fresh_path(spark, "landing")
    spark.read.parquet(f"{sf}/events.parquet").repartition(20).write.parquet(source)
    schema = spark.read.parquet(source).schema
    given = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    streams.start_landing(spark.sql(fx.RAW_LINES, events=given), path, fresh_path(spark, "offsets"), {"availableNow": True},
                          F.col("event_ts")).awaitTermination()
    return streams.stored_rows(spark, path)


FACT_COLUMNS = ["id", "event_ts", "user_id", "action_id", "alert_score", "prelim_priority"]


def streamed_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Warehouse facts as a stream of three batches."""
    source = fresh_path(spark, "events")
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(source)
    given = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    return spark.sql(fx.WH_FACT, events=given).select(*FACT_COLUMNS)


@query("stream_cards", fx.oracle(**WH) + f"""
, total as (select count(*) as n, count(*) filter (upper(prelim_priority) = 'HIGH') as high, count(distinct user_id) as users,
  avg(alert_score) as mean from fact),
days as (select strftime(event_ts, '%Y-%m-%d') as day, count(*) as n, avg(alert_score) filter (alert_score <> 0) as mean
  from fact where event_ts is not null group by 1),
people as (select cast(user_id as varchar) as name, count(*) filter (upper(prelim_priority) = 'HIGH') as high
  from fact where user_id is not null group by 1)
select 'stats' as card, v.name, cast(null as bigint) as v, v.value from total, lateral (values ('total_alerts', cast(n as double)),
  ('critical_alerts', cast(high as double)), ('unique_users', cast(users as double)),
  ('avg_risk_score', {sql_even(sql_round('coalesce(mean, 0.0)', 6) + ' * 10000.0', 2)})) as v(name, value)
union all select 'trend', day, n, {sql_round('coalesce(mean, 0.0)', 2)} from days
union all select 'priority', prelim_priority, count(*), max(alert_score) from fact group by prelim_priority
union all select 'action', cast(action_id as varchar), count(*), max(alert_score) from fact group by action_id
union all (select 'top_users', name, high, cast(null as double) from people where high > 0 order by high desc, name limit 5)""")
def stream_cards(spark, sf):
    path = fresh_path(spark, "cards")
    cards.start_cards(streamed_facts(spark, sf), path, fresh_path(spark, "offsets"), {"availableNow": True}).awaitTermination()
    return cards.all_cards(cards.totals_table(spark, path).read())


@query("stream_lists", fx.oracle(**WH) + f"""
, best as (select *, row_number() over (order by alert_score desc, id) as by_score from fact where alert_score is not null),
newest as (select *, row_number() over (order by event_ts desc, id) as by_time from fact where event_ts is not null)
select {", ".join(FACT_COLUMNS)}, 'highest' as list from best where by_score <= 100
union all select {", ".join(FACT_COLUMNS)}, 'newest' from newest where by_time <= 100""")
def stream_lists(spark, sf):
    path, facts = fresh_path(spark, "lists"), streamed_facts(spark, sf)
    cards.start_lists(facts, path, fresh_path(spark, "offsets"), facts.schema, {"availableNow": True}).awaitTermination()
    return cards.latest_lists(spark, path, facts.schema)
