"""Audit-shaped inputs derived from the given tables.

Each text is plain SQL that Spark and the oracle both run, with the source tables
as {placeholders}. Every derived table covers all rows of its source.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

CT_EVENTS = """
select event_id, cast(floor(event_id / 100) as bigint) as request_id, ts as event_ts, user_id,
 case event_id % 16 when 0 then 'CreateAccessKey' when 1 then 'DeleteAccessKey' when 2 then 'AttachUserPolicy'
  when 3 then 'AttachRolePolicy' when 4 then 'PutUserPolicy' when 5 then 'CreateUser' when 6 then 'DeleteUser'
  when 7 then 'DeleteTrail' when 8 then 'StopLogging' when 9 then 'ConsoleLogin' when 10 then 'AssumeRole'
  when 11 then 'CreateLoginProfile' when 12 then 'ListUsers' when 13 then 'GetObject' when 14 then 'createuser'
  else 'DeactivateMFADevice' end as event_name,
 case user_id % 12 when 0 then 'admin' when 1 then 'backup' when 2 then 'Level6' when 3 then 'securityMonkey'
  when 4 then null else concat('user-', cast(user_id as string)) end as user_name,
 case when user_id % 24 = 4 then concat('arn:aws:iam::123456789012:user/u', cast(user_id as string)) end as arn,
 case (event_id + user_id) % 11 when 0 then concat('10.0.0.', cast(user_id % 256 as string)) when 1 then '192.168.1.20'
  when 2 then '172.16.4.4' when 3 then '172.200.1.1' when 4 then concat('45.67.89.', cast(user_id % 256 as string))
  when 5 then '185.220.101.45' when 6 then 'ec2.amazonaws.com' when 7 then '999.1.1.1 10.0.0.1' when 8 then '010.0.0.1'
  when 9 then null else concat('203.0.113.', cast(user_id % 7 as string)) end as source_ip_address,
 case event_id % 3 when 0 then 'us-east-1' when 1 then 'ap-south-1' else null end as aws_region,
 case event_id % 5 when 0 then 'iam.amazonaws.com' when 1 then 's3.amazonaws.com' else null end as event_source,
 case event_type when 'error' then 'AccessDenied' when 'signup' then '' else null end as error_code,
 case event_id % 7 when 0 then 'array' when 1 then 'object' when 2 then 'cut off' when 3 then 'mixed'
  when 4 then 'empty' when 5 then 'null' else 'two events' end as shape
from {events}
"""

ENRICHED_FLAT = """
select event_id as id, case when event_id % 500 = 7 then null else ts end as event_ts,
 case user_id % 12 when 0 then 'admin' when 1 then 'backup' when 2 then 'Level6' when 3 then 'securityMonkey'
  when 4 then null else concat('user-', cast(user_id as string)) end as user_name,
 case event_id % 6 when 0 then 'CreateAccessKey' when 1 then 'ConsoleLogin' when 2 then 'ListUsers'
  when 3 then 'consolelogin' when 4 then 'DeleteTrail' else null end as action,
 case when event_id % 10 = 9 then null else concat('203.0.113.', cast(user_id % 50 as string)) end as src_ip,
 case when event_type = 'error' then 'FAILED' else 'SUCCESS' end as result, event_type = 'error' as result_flag,
 case when event_id % 97 = 0 then null else cast(event_id * 37 % 1001 as double) / 1000 end as alert_score,
 case event_id % 7 when 0 then 'HIGH' when 1 then 'high' when 2 then 'MEDIUM' when 3 then 'LOW' when 4 then 'CRITICAL'
  when 5 then '' else null end as prelim_priority,
 case user_id % 5 when 0 then 1 when 1 then 3 when 2 then 6 when 3 then 8 else null end as ti_score,
 cast(event_id % 11 as double) / 10 as ip_score,
 case user_id % 4 when 0 then 'US' when 1 then 'IN' when 2 then 'NA' else null end as country,
 case user_id % 3 when 0 then 'DE' when 1 then 'BR' else null end as ti_country,
 concat('AS', cast(user_id % 9 as string)) as ti_asn, value / 10 as final_risk_score
from {events}
"""

# Logs with many addresses, in two loads: before and after the middle of January.
SIGHTINGS = """
select event_id as id, ts as event_ts, case when ts < timestamp '2024-01-16 00:00:00' then 1 else 2 end as load_no,
 case user_id % 12 when 4 then null else concat('user-', cast(user_id as string)) end as user_name,
 case event_id % 6 when 0 then 'CreateAccessKey' when 1 then 'ConsoleLogin' when 2 then 'ListUsers'
  when 3 then 'consolelogin' when 4 then 'DeleteTrail' else null end as action,
 concat('198.', cast(event_id % 97 as string), '.', cast(cast(floor(user_id / 256) as bigint) % 256 as string), '.',
  cast(user_id % 256 as string)) as src_ip,
 case event_id % 4 when 0 then 'US' when 1 then 'IN' when 2 then 'NA' else null end as country,
 cast(case event_id % 5 when 0 then 1 when 1 then 3 when 2 then 6 when 3 then 8 else null end as int) as ti_score,
 case event_id % 3 when 0 then 'DE' when 1 then 'BR' else null end as ti_country,
 case when event_type = 'error' then 'FAILED' else 'SUCCESS' end as result, event_type = 'error' as result_flag,
 cast(event_id * 37 % 1001 as double) / 1000 as alert_score,
 case event_id % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as prelim_priority
from {events}
"""

IP_REPUTATION = """
select * from (values ('185.220.101.45', 100, 'DE', 'AS60729'), ('203.0.113.0', 9, 'US', 'AS64500'),
 ('203.0.113.1', 10, 'US', 'AS64500'), ('203.0.113.2', 29, 'IN', 'AS64501'), ('203.0.113.3', 30, 'IN', 'AS64501'),
 ('203.0.113.4', 59, 'BR', 'AS64502'), ('203.0.113.5', 79, 'BR', 'AS64502'), ('172.200.1.1', 80, 'US', 'AS64503'))
 as t(ip, abuse_confidence, country, asn)
"""

FLAGGED_EVENTS = """
select event_id,
 case event_id % 5 when 0 then '2024-03-01 10:20:30' when 1 then '2024-03-01' when 2 then 'not a date' when 3 then null
  else '2024-12-31 23:59:59' end as eventtime,
 case event_id % 6 when 0 then ' ConsoleLogin ' when 1 then 'nan' when 2 then 'NULL' when 3 then '' when 4 then null
  else 'GetObject' end as eventname,
 case user_id % 3 when 0 then 'None' when 1 then ' admin ' else concat('u', cast(user_id as string)) end as useridentityusername,
 case user_id % 4 when 0 then null when 1 then ' 10.0.0.1 ' else '45.67.89.10' end as sourceipaddress,
 case event_id % 3 when 0 then 'us-east-1' when 1 then 'none' else null end as awsregion,
 case event_id % 2 when 0 then 'iam.amazonaws.com' else 'null' end as eventsource,
 cast(case when event_id % 4 = 0 then 1 when event_id % 4 = 1 then 0 else null end as int) as is_login,
 cast(case when event_id % 3 = 0 then 1 else 0 end as int) as is_iam,
 cast(case when event_id % 2 = 0 then 1 else 0 end as int) as is_s3
from {events}
"""

LOG_CANDIDATES = """
select event_id, case when event_id % 31 = 0 then null else user_id end as user_id,
 case when event_id % 37 = 0 then null else event_id % 6 end as action_id, user_id % 50 as ip_id,
 case when event_id % 41 = 0 then null else 'SUCCESS' end as result,
 case event_id % 9 when 0 then 'abc' when 1 then '-1' when 2 then '10' when 3 then '10.5' when 4 then null
  when 5 then 'NaN' else '7.25' end as alert_score,
 case event_id % 5 when 0 then 'low' when 1 then 'Medium' when 2 then 'HIGH' when 3 then 'CRITICAL' else 'HIGH' end as prelim_priority,
 case event_id % 4 when 0 then '1.2.3.4' when 1 then '999.999.999.999' when 2 then '1.2.3' else null end as ip
from {events}
"""

RAW_LINES = """
select event_id, ts as event_ts, case event_type
  when 'error' then concat('Jan 01 sshd[1]: Failed password for root from 45.67.89.', cast(user_id as string), ' port 22')
  when 'click' then concat('GET /index from 10.1.2.', cast(user_id as string))
  when 'view' then 'no address here' when 'signup' then 'bad 300.1.1.1 then 8.8.8.8'
  else concat('Failed password for alice from 192.168.0.', cast(user_id as string)) end as raw_log
from {events}
"""

CSV_EXTRACT = """
select event_id, case event_id % 4 when 0 then '2024-03-01 10:20:30' when 1 then '2024-03-01' when 2 then 'yesterday'
  else null end as eventTime,
 case user_id % 4 when 0 then null else concat('user-', cast(user_id as string)) end as userIdentityuserName,
 case event_id % 3 when 0 then 'ConsoleLogin' when 1 then 'ListUsers' else null end as eventName,
 concat('10.0.', cast(user_id % 256 as string), '.1') as sourceIPAddress,
 case when event_type = 'error' then 'FAILED' else 'SUCCESS' end as result
from {events}
"""

BROKEN_IPS = """
select event_id, case event_id % 12 when 0 then '5.205' when 1 then 'abc' when 2 then '300.1.1.1' when 3 then '1.2.3.4.5'
  when 4 then '-' when 5 then ' Unknown ' when 6 then null when 7 then '' when 8 then '007.08.9.1234567890123'
  when 9 then '1..2.x.3' when 10 then concat(' 10.0.', cast(user_id as string), ' ') else concat('10.1.2.', cast(user_id as string))
  end as src_ip
from {events}
"""

# Warehouse whose dimensions are given tables: customers are users, suppliers addresses.
WH_USERS = """
select c_custkey as user_id, case c_custkey when 1 then 'admin' when 2 then 'backup' when 3 then 'Level6'
  when 4 then 'securityMonkey' when 5 then 'unknown' else case when c_custkey % 2 = 0 then upper(c_name) else c_name end
  end as username
from {customer}
"""

WH_ACTIONS = """
select * from (values (0, 'CreateAccessKey'), (1, 'ConsoleLogin'), (2, 'ListUsers'), (3, 'GetObject'), (4, 'DeleteTrail'),
 (5, 'AssumeRole'), (6, 'StopLogging'), (7, '')) as t(action_id, action_name)
"""

WH_IPS = """
select s_suppkey as ip_id, concat('198.', cast(cast(floor(s_suppkey / 65536) as bigint) % 256 as string), '.',
  cast(cast(floor(s_suppkey / 256) as bigint) % 256 as string), '.', cast(s_suppkey % 256 as string)) as src_ip,
 upper(substr(n_name, 1, 2)) as country, cast(s_suppkey % 11 as int) as ti_score
from {supplier} left join {nation} on s_nationkey = n_nationkey
"""

WH_FACT = """
select event_id as id, case when event_id % 500 = 7 then null else ts end as event_ts,
 case when event_id % 50 = 3 then null else user_id end as user_id, event_id % 9 as action_id, user_id % 120 as ip_id,
 case when event_type = 'error' then 'FAILED' else 'SUCCESS' end as result, event_type = 'error' as result_flag,
 case when event_id % 97 = 0 then null else cast(event_id * 37 % 1001 as double) / 1000 end as alert_score,
 case event_id % 7 when 0 then 'HIGH' when 1 then 'high' when 2 then 'MEDIUM' when 3 then 'LOW' when 4 then 'CRITICAL'
  when 5 then '' else null end as prelim_priority,
 case user_id % 3 when 0 then 'DE' when 1 then 'BR' else null end as ti_country,
 concat('AS', cast(user_id % 9 as string)) as ti_asn
from {events}
"""

SOURCES = ["events", "customer", "supplier", "nation"]


def derive(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a fixture text over the tables of `sf_dir`."""
    tables = {
        name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        for name in SOURCES if "{" + name + "}" in text
    }
    return spark.sql(text, **tables)


def oracle(**texts: str) -> str:
    """Leading WITH clause naming each derived table."""
    parts = []
    for name, text in texts.items():
        for source in SOURCES:
            text = text.replace("{" + source + "}", source)
        parts.append(f"{name} as ({text})")
    return "with " + ", ".join(parts) + " "


def _event_json():
    return F.struct(
        F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"),
        F.col("event_name").alias("eventName"),
        F.col("source_ip_address").alias("sourceIPAddress"),
        F.col("aws_region").alias("awsRegion"),
        F.col("event_source").alias("eventSource"),
        F.col("error_code").alias("errorCode"),
        F.when(F.coalesce("user_name", "arn").isNotNull(),
               F.struct(F.col("user_name").alias("userName"), "arn")).alias("userIdentity"),
    )


def payload_requests(events: DataFrame) -> DataFrame:
    """One array payload per request; request_id is event_id div 100, so an array has at most 100 events."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("event_id", _event_json().alias("e")))), lambda s: s["e"])
    return events.groupBy("request_id").agg(F.to_json(ordered).alias("payload"))


def payload_cases(events: DataFrame) -> DataFrame:
    """One payload per event, in the good or bad shape its row names."""
    event, shape = F.to_json(_event_json()), F.col("shape")
    return events.select(
        F.col("event_id").alias("request_id"),
        F.when(shape == "array", F.concat(F.lit("["), event, F.lit("]")))
        .when(shape == "object", event)
        .when(shape == "cut off", F.concat(F.lit("["), event))
        .when(shape == "mixed", F.concat(F.lit("["), event, F.lit(', 5, "text", null, '), event, F.lit("]")))
        .when(shape == "empty", F.lit("[]"))
        .when(shape == "null", F.lit("null"))
        .otherwise(F.lit('[{"eventName":"ListUsers","errorCode":0}, {"eventName":"DeleteTrail","errorCode":["x"]}]'))
        .alias("payload"),
    )
