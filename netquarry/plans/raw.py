"""One plan from captured bytes to alerts: parsed once, both lanes, questions and fingerprints, scores, thresholds, fusion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import scratch_path, ship
from ..functions import fingerprints as fp
from ..functions import text
from ..models.base import INPUTS
from ..operators import alerting, flows, lookups, windows
from ..operators.flows import Limits
from ..sources import wire
from . import catalog, views
from .catalog import CHARS, FLOW, VECTOR, _entropy_sql, query
from .views import DAY, LIMITS

#: By class: what adds raw_score to its rows, a fitted detector's ``score`` or a rule.
Detectors = dict[str, Callable[[DataFrame], DataFrame]]


def _rule(score: Callable[[], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.withColumn("raw_score", alerting.six_digits(F.least(F.lit(1.0), score())))


_six = lambda name: alerting.six_digits(F.col(name))

#: Scores by rule, in place of detectors that have not been fitted.
RULES: Detectors = {
    "ddos": _rule(lambda: F.col("packet_count") / 8.0 + _six("syn_ratio") / 4.0),
    "port_scanning": _rule(lambda: F.col("unique_dest_ports_est") / 4.0 + _six("dest_port_entropy") / 8.0),
    "c2_beaconing": _rule(lambda: F.col("packet_count") / 5.0),
    "exfiltration": _rule(lambda: _six("packet_ratio_out") * 0.75),
    "dga": _rule(lambda: _six("char_entropy") / 4.0),
    "encrypted_malware": _rule(lambda: F.col("ja4_known_bad") * 0.9),
}


def results(parsed: DataFrame, intel: DataFrame, detectors: Detectors, limits: Limits, width_us: int) -> DataFrame:
    """Scored rows of all six classes, as :mod:`netquarry.operators.alerting` takes them, grouped by source and window.

    ``parsed`` (event_id, us and a packet's fields and payload) is read once for each lane: store it. Source windows go to the DDoS and
    scan detectors, flows to those of beacons and exfiltration, questions sent to port 53 to that of generated names, and ClientHellos, with the
    look-up of their fingerprints, to that of malware. ``evidence`` holds a result's inputs, and of a ClientHello the fingerprint and whether it is known.
    """
    none = F.lit(None)

    def result(rows: DataFrame, threat: str, ip: str, us: Column, known_bad: Column | None = None, flow: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
        scored = detectors[threat](rows)
        told = [c for c in (*INPUTS[threat], *more) if c in scored.columns]
        evidence = F.map_from_arrays(F.array(*map(F.lit, told)), F.array(*[F.col(c).cast("string") for c in told]))
        end = lambda c, t: (F.col(c) if flow else none).cast(t)
        return scored.select(
            F.concat_ws("@", F.col(ip), windows.window_start(us, width_us).cast("string")).alias("group_id"), F.lit(threat).alias("threat_class"), F.lit("detector").alias("model_name"), "raw_score", none.cast("double").alias("calibrated_confidence"),
            (F.lit(False) if known_bad is None else known_bad).alias("ja4_known_bad"), F.col(ip).alias("source_ip"), none.cast("string").alias("src_ip"), none.cast("string").alias("dst_ip"), end("a_ip", "string").alias("flow_src_ip"),
            end("a_port", "int").alias("flow_src_port"), end("b_ip", "string").alias("flow_dst_ip"), end("b_port", "int").alias("flow_dst_port"), end("protocol", "string").alias("flow_protocol"),
            windows.window_start(us, width_us).alias("observed_us"), evidence.alias("evidence"),
        )

    sources = windows.source_vector(parsed, width_us)
    lanes = [result(sources, c, "src_ip", F.col("win")) for c in ("ddos", "port_scanning")]
    confirmed = flows.vectors(parsed, limits)
    lanes += [result(confirmed, c, "a_ip", F.col("last_us"), flow=True) for c in ("c2_beaconing", "exfiltration")]

    messages = parsed.where("protocol = 'UDP' AND (dst_port = 53 OR src_port = 53)").select("us", "src_ip", "dst_ip", wire.parse_dns(F.col("payload")).alias("m")).where("m IS NOT NULL AND NOT m.is_response")
    asked = messages.select("us", "src_ip", F.explode("m.questions").alias("q")).withColumn("s", text.domain_label(F.col("q.qname")))
    s = F.col("s")
    names = asked.select("us", "src_ip", F.col("q.qname").alias("domain"), text.char_entropy(s).alias("char_entropy"), text.ngram_entropy(s).alias("bigram_entropy"), F.length(s).cast("double").alias("length"), text.digit_ratio(s).alias("digit_ratio"), text.vowel_ratio(s).alias("vowel_ratio"))
    lanes.append(result(names, "dga", "src_ip", F.col("us"), more=("domain",)))

    greeting = (F.col("protocol") == "TCP") & (F.substring(F.hex(F.substring("payload", 1, 1)), 1, 2) == "16")
    hellos = parsed.where(greeting).select("us", "src_ip", wire.parse_client_hello(F.col("payload")).alias("m")).where("m IS NOT NULL")
    m = lambda c: F.col(f"m.{c}")
    shaped = hellos.withColumn("ja4", fp.ja4(m("legacy_version"), m("supported_versions"), m("sni"), m("ciphers"), m("extensions"), m("signature_algorithms"), m("alpn_protocols")))
    looked = lookups.lookup(shaped, intel)
    structure = fp.structure(*map(m, ("legacy_version", "supported_versions", "sni", "ciphers", "extensions", "supported_groups", "ec_point_formats", "signature_algorithms", "alpn_protocols")), F.col("hit"))
    lanes.append(result(looked.select("us", "src_ip", "ja4", "hit", *[c.alias(n) for n, c in structure.items()]), "encrypted_malware", "src_ip", F.col("us"), F.col("hit"), more=("ja4",)))
    out = lanes[0]
    for lane in lanes[1:]:
        out = out.unionByName(lane)
    return out


def frames(spark, d) -> DataFrame:
    """event_id, us, raw: bare IPv4 packets of the derived fields, with a DNS message in UDP packets of port 53 and a ClientHello in TCP packets to port 443.

    Packets take their greetings from hellos 1 to 150 in turn (from -148 where an event's number is negative), so no others are made for them. The
    planner would take all hellos for a few bytes each, and bring a table of any size through the driver."""
    h = catalog._hex
    p = views.packets(spark, d)
    messages = views.dns(spark, d).join(views.packets(spark, d).select("event_id", "k"), "event_id").select("event_id", catalog.dns_hex().alias("message"))
    greetings = views.hellos(spark, d).where(F.col("k").between(-148, 150)).select(F.col("k").alias("hello"), catalog.hello_hex().alias("greeting"))
    p = p.join(messages, "event_id").join(F.broadcast(greetings), (F.col("event_id") % 150 + 1) == F.col("hello"), "left")
    is_dns = (F.col("protocol") == "UDP") & ((F.col("dst_port") == 53) | (F.col("src_port") == 53))
    udp = F.when(is_dns, F.col("message")).otherwise("")
    tcp = F.when(F.col("dst_port") == 443, F.coalesce("greeting", F.lit(""))).otherwise("")
    number = F.when(F.col("protocol") == "TCP", "06").when(F.col("protocol") == "UDP", "11").when(F.col("protocol") == "ICMP", "01").otherwise("2F")
    ports = F.concat(h(F.col("src_port"), 4), h(F.col("dst_port"), 4))
    body = (
        F.when(F.col("protocol") == "TCP", F.concat(ports, F.lit("00" * 8 + "50"), F.when(F.col("syn"), "02").otherwise("10"), F.lit("00" * 6), tcp))
        .when(F.col("protocol") == "UDP", F.concat(ports, h(F.length(udp) / 2 + 8, 4), F.lit("0000"), udp)).otherwise(F.lit("00" * 20))
    )
    whole = F.concat(F.lit("4500"), h(F.length(body) / 2 + 20, 4), F.lit("0000000040"), number, F.lit("0000"), views.wire_address(F.col("src_ip")), views.wire_address(F.col("dst_ip")), body)
    return p.select("event_id", "us", F.unhex(whole).alias("raw"))


LEVELS = [(c, 0.8, 0.5) for (c,) in views.CLASS_ROWS]
#: What the parser makes of the frames: other protocols have no ports.
GIVEN = views.PACKETS.replace("packets AS (", "given AS (", 1) + """, packets AS (SELECT event_id, us, src_ip, dst_ip, CASE WHEN protocol IN ('TCP', 'UDP') THEN src_port ELSE 0 END AS src_port, CASE WHEN protocol IN ('TCP', 'UDP') THEN dst_port ELSE 0 END AS dst_port,
    protocol, packet_size, protocol = 'TCP' AND syn AS syn, k FROM given)"""
_rest = lambda sql: sql.split(views.PACKETS, 1)[1]
RAW = f"""WITH RECURSIVE {GIVEN}{_rest(FLOW)}{_rest(VECTOR)}{_rest(views.DNS)}, {views.HELLOS},
wired AS (SELECT k, 't' || version_code || CASE WHEN coalesce(sni, '') <> '' THEN 'd' ELSE 'i' END || printf('%02d', least(len(c), 99)) || printf('%02d', 4 + CASE WHEN coalesce(sni, '') <> '' THEN 1 ELSE 0 END + CASE WHEN alpn IS NULL THEN 0 ELSE 1 END) || alpn_code || '_' || cipher_hash
    || '_' || sha256('000a,000b,000d,002b' || CASE WHEN len(sx) > 0 THEN '_' || array_to_string(sx, ',') ELSE '' END)[1:12] AS ja4 FROM f),
intel AS (SELECT ja4, 'family' || k % 5 AS malware_family FROM wired WHERE k % 7 = 0 QUALIFY row_number() OVER (PARTITION BY ja4 ORDER BY k DESC) = 1),
asked AS (SELECT us, src_ip, split_part(q.qname, '.', 1) AS s FROM (SELECT event_id, unnest(questions) AS q FROM dns WHERE NOT is_response) JOIN packets USING (event_id) WHERE protocol = 'UDP' AND (src_port = 53 OR dst_port = 53)),
greeted AS (SELECT p.us, p.src_ip, i.malware_family IS NOT NULL AS hit FROM packets p JOIN (SELECT k AS hello, x.ja4, malware_family FROM wired x LEFT JOIN intel USING (ja4)) i ON p.event_id % 150 + 1 = i.hello WHERE p.protocol = 'TCP' AND p.dst_port = 443),
rules AS (
    SELECT src_ip AS ip, win, 'ddos' AS threat_class, least(1.0, packet_count / 8.0 + syn_ratio / 4.0) AS s, false AS bad FROM vec
    UNION ALL SELECT src_ip, win, 'port_scanning', least(1.0, unique_dest_ports_est / 4.0 + dest_port_entropy / 8.0), false FROM vec
    UNION ALL SELECT a_ip, last_us - last_us % {DAY}, 'c2_beaconing', least(1.0, packet_count / 5.0), false FROM flow
    UNION ALL SELECT a_ip, last_us - last_us % {DAY}, 'exfiltration', least(1.0, packet_ratio_out * 0.75), false FROM flow
    UNION ALL SELECT src_ip, us - us % {DAY}, 'dga', least(1.0, ({_entropy_sql(CHARS)}) / 4.0), false FROM asked
    UNION ALL SELECT src_ip, us - us % {DAY}, 'encrypted_malware', CASE WHEN hit THEN 0.9 ELSE 0 END, hit FROM greeted
), sev AS (SELECT ip, win, threat_class, round(s, 6) AS s, bad, CASE WHEN round(s, 6) >= 0.8 THEN 'HIGH' WHEN round(s, 6) >= 0.5 THEN 'MEDIUM' END AS severity FROM rules)
SELECT ip AS source_ip, win, CASE WHEN count(DISTINCT CASE WHEN severity = 'HIGH' THEN threat_class END) >= 2 OR bool_or(bad) THEN 'CRITICAL' WHEN bool_or(severity = 'HIGH') THEN 'HIGH' ELSE 'MEDIUM' END AS overall_severity,
       round(1 - product(1 - s), 6) AS overall_score, count(*) AS threats_detected_count, string_agg(threat_class, ',' ORDER BY threat_class) AS classes FROM sev WHERE severity IS NOT NULL GROUP BY ip, win"""


def parsed(spark, d) -> DataFrame:
    """The frames, parsed once and stored for all lanes; hosts under their names in the sample tables."""
    ship(spark)
    rows = frames(spark, d).withColumn("p", wire.parse_packet(F.col("raw"))).where("p IS NOT NULL").select("event_id", "us", "p.*")
    rows = rows.withColumns({c: views.host_name(F.col(c)) for c in ("src_ip", "dst_ip")})
    path = scratch_path(spark, "parsed")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def known_bad(spark, d) -> DataFrame:
    """Intelligence of every seventh hello as it looks on the wire, where a hello names the extensions that it carries."""
    seen = views.hellos(spark, d).select("k", wire.parse_client_hello(F.unhex(catalog.hello_hex())).alias("m"))
    m = lambda c: F.col(f"m.{c}")
    marked = seen.select("k", fp.ja4(m("legacy_version"), m("supported_versions"), m("sni"), m("ciphers"), m("extensions"), m("signature_algorithms"), m("alpn_protocols")).alias("ja4"))
    return lookups.latest(views.intel(spark, d, marked), ["ja4"], "nth")


def alerts_of(spark, d, detectors: Detectors) -> DataFrame:
    levels = spark.createDataFrame(LEVELS, "threat_class string, high_threshold double, medium_threshold double")
    return alerting.alerts(results(parsed(spark, d), known_bad(spark, d), detectors, LIMITS, DAY), levels)


@query(RAW)
def raw_to_alerts(spark, d):
    """From bytes to alerts, with a rule in the place of each detector."""
    made = alerts_of(spark, d, RULES)
    classes = F.array_join(F.array_sort(F.transform("detections", lambda x: x["threat_class"])), ",")
    return made.select("source_ip", F.col("observed_us").alias("win"), "overall_severity", alerting.six_digits(F.col("overall_score")).alias("overall_score"), "threats_detected_count", classes.alias("classes"))
