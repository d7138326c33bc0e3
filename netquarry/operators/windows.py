"""Aggregates of a tumbling window for each source and each DNS client.

A time column holds microseconds; windows are aligned to the epoch. Every operator is one hash aggregation with
partial sums, or two for entropies (counts by category first), so a hot source is summed before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.network import ratio, rcode_name


def window_start(us: Column, width_us: int) -> Column:
    return us - F.pmod(us, F.lit(width_us))


def windowed(df: DataFrame, width_us: int) -> DataFrame:
    return df.withColumn("win", window_start(F.col("us"), width_us))


def _port() -> Column:
    return F.coalesce(F.col("dst_port"), F.lit(0))


def source_counts(packets: DataFrame, width_us: int) -> DataFrame:
    syn = F.sum(F.col("syn").cast("long"))
    return windowed(packets, width_us).groupBy("win", "src_ip").agg(
        F.count("*").alias("packet_count"), F.sum("packet_size").alias("byte_count"), syn.alias("syn_count"), ratio(syn, F.count("*"), 0.0).alias("syn_ratio")
    )


def source_fanout(packets: DataFrame, width_us: int, exact: bool = True, lg_k: int = 12) -> DataFrame:
    """Distinct destinations: exact, or estimated by mergeable HyperLogLog sketches."""
    count = F.countDistinct if exact else lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(lg_k)))
    rows = windowed(packets, width_us).withColumn("port", _port())
    return rows.groupBy("win", "src_ip").agg(count(F.col("dst_ip")).alias("unique_dest_ips_est"), count(F.col("port")).alias("unique_dest_ports_est"))


def entropy_by(df: DataFrame, keys: list[str], category: Column) -> DataFrame:
    """keys, entropy (bits), distinct_categories, total_observations."""
    counts = df.withColumn("category", category).groupBy(*keys, "category").agg(F.count("*").alias("n"))
    total, weighted = F.sum("n"), F.sum(F.col("n") * F.log2(F.col("n").cast("double")))
    bits = F.greatest(F.log2(total.cast("double")) - weighted / total, F.lit(0.0))
    return counts.groupBy(*keys).agg(bits.alias("entropy"), F.count("*").alias("distinct_categories"), total.alias("total_observations"))


def source_vector(packets: DataFrame, width_us: int) -> DataFrame:
    """The whole vector of a source's window, in one scan and without a join.

    Grouping sets count each window's packets by destination port, by protocol and by destination at once; a second aggregate
    takes entropies and distinct counts from those counts. What is shuffled follows the different values, not the packets.
    """
    rows = windowed(packets, width_us).withColumn("port", _port())
    keys = ["win", "src_ip"]
    counts = rows.groupingSets([[*keys, "port"], [*keys, "protocol"], [*keys, "dst_ip"]], *keys, "port", "protocol", "dst_ip").agg(
        F.count("*").alias("n"), F.sum("packet_size").alias("bytes"), F.sum(F.col("syn").cast("long")).alias("syn"), F.grouping("port").alias("no_port"), F.grouping("protocol").alias("no_protocol")
    )
    by_port, by_protocol = F.col("no_port") == 0, F.col("no_protocol") == 0
    n, syn = F.sum(F.when(by_protocol, F.col("n"))), F.sum(F.when(by_protocol, F.col("syn")))
    return counts.groupBy(*keys).agg(
        F.count("dst_ip").alias("unique_dest_ips_est"), F.count(F.when(by_port, 1)).alias("unique_dest_ports_est"), _bits(by_port, n).alias("dest_port_entropy"), n.alias("packet_count"),
        F.sum(F.when(by_protocol, F.col("bytes"))).alias("byte_count"), syn.alias("syn_count"), ratio(syn, n, 0.0).alias("syn_ratio"), _bits(by_protocol, n).alias("protocol_entropy"),
    )


def _bits(chosen: Column, total: Column) -> Column:
    """Entropy of the counts n of the chosen rows, which add up to ``total``; 0 for none."""
    weighted = F.sum(F.when(chosen, F.col("n") * F.log2(F.col("n").cast("double"))))
    return F.coalesce(F.greatest(F.log2(total.cast("double")) - weighted / total, F.lit(0.0)), F.lit(0.0))


def port_frequency(packets: DataFrame) -> DataFrame:
    return packets.groupBy("src_ip", _port().alias("port")).agg(F.count("*").alias("n"))


def dns_client(messages: DataFrame) -> DataFrame:
    """A response belongs to the client it goes to, a query to the one it comes from."""
    return messages.withColumn("client_ip", F.when(F.col("is_response"), F.col("dst_ip")).otherwise(F.col("src_ip")))


def dns_queries(messages: DataFrame, width_us: int) -> DataFrame:
    """Query side of a client's window in one scan. Messages count once, whatever their number of questions.

    Questions are counted by name and by type at once; the entropy of a name's first label is computed for each different name.
    Its moments are weighted sums of values of a few bits, so squares lose no precision.
    """
    queries = windowed(dns_client(messages), width_us).where(~F.col("is_response"))
    asked = queries.select("win", "client_ip", F.posexplode_outer("questions").alias("pos", "q")).select("win", "client_ip", F.coalesce("pos", F.lit(0)).alias("pos"), "q.qname", "q.qtype", F.col("q").isNotNull().cast("long").alias("one"))
    keys = ["win", "client_ip"]
    counts = asked.groupingSets([[*keys, "qname"], [*keys, "qtype"]], *keys, "qname", "qtype").agg(
        F.sum("one").alias("n"), F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("sent"), F.grouping("qname").alias("no_name")
    )
    counts = counts.withColumn("bits", F.when((F.col("no_name") == 0) & (F.col("n") > 0), text.char_entropy(text.domain_label(F.col("qname")))))
    by_type, n = (F.col("no_name") == 1) & (F.col("n") > 0), F.col("n")
    total = F.sum(F.when(by_type, n))
    mean = F.sum(n * F.col("bits")) / total
    return counts.groupBy(*keys).agg(
        F.sum(F.when(F.col("no_name") == 1, F.col("sent"))).alias("query_count"), F.count("qname").alias("unique_domains_est"), F.coalesce(total, F.lit(0)).alias("domain_n"),
        mean.alias("domain_mean"), F.greatest(F.sum(n * F.col("bits") * F.col("bits")) / total - mean * mean, F.lit(0.0)).alias("domain_variance"), _bits(by_type, total).alias("query_type_entropy"),
    )


def min_answer_ttl(answers: Column) -> Column:
    return F.array_min(F.transform(answers, lambda a: a["ttl"]))


def dns_responses(messages: DataFrame, width_us: int) -> DataFrame:
    rows = windowed(dns_client(messages), width_us).where("is_response").withColumn("ttl", min_answer_ttl(F.col("answers")))
    missing = F.sum((rcode_name(F.col("rcode")) == "NXDOMAIN").cast("long"))
    return rows.groupBy("win", "client_ip").agg(
        F.count("*").alias("response_count"), missing.alias("nxdomain_count"), ratio(missing, F.count("*"), 0.0).alias("nxdomain_rate"),
        F.count("ttl").alias("ttl_n"), F.avg("ttl").alias("ttl_mean"), F.var_pop("ttl").alias("ttl_variance"),
    )


def dns_vector(messages: DataFrame, width_us: int) -> DataFrame:
    both = dns_queries(messages, width_us).join(dns_responses(messages, width_us), ["win", "client_ip"], "full")
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("unique_domains_est", "query_count", "response_count", "nxdomain_count", "domain_n", "ttl_n")}
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("nxdomain_rate", "query_type_entropy", "domain_mean", "domain_variance", "ttl_mean", "ttl_variance")}
    return both.withColumns(filled | zero)


def emission_union(sources: DataFrame, clients: DataFrame) -> DataFrame:
    """Both kinds of window vectors, tagged; fields that one kind lacks are null."""
    a = sources.withColumnRenamed("src_ip", "source_ip").withColumn("aggregate_type", F.lit("source"))
    return a.unionByName(clients.withColumn("aggregate_type", F.lit("dns")), allowMissingColumns=True).withColumn("emission_reason", F.lit("window"))


def routes(vectors: DataFrame) -> DataFrame:
    """The detectors that score each vector: two for a source window and a timed-out flow, none (pending) otherwise."""
    names = (
        F.when(F.col("aggregate_type") == "source", F.array(F.lit("ddos"), F.lit("port_scanning")))
        .when(F.col("emission_reason") == "flow_timeout", F.array(F.lit("c2_beaconing"), F.lit("exfiltration")))
        .otherwise(F.array(F.lit("pending")))
    )
    return vectors.withColumn("route", F.explode(names))


def opportunistic(packets: DataFrame, width_us: int) -> DataFrame:
    """(src_ip, us, dst_port, packet_size, fired_us): each packet with the begin of its window, where a source's window begins at its first
    packet after the last one ended. Sequential for a source by nature: its packets are sorted externally and folded as they stream by."""

    def run(batches):
        import pandas as pd

        source, fired = None, 0
        for batch in batches:
            out = []
            for ip, us in zip(batch.src_ip, batch.us, strict=True):
                if ip != source or us - fired >= width_us:
                    source, fired = ip, us
                out.append(fired)
            yield batch.assign(fired_us=pd.Series(out, index=batch.index, dtype="int64"))

    rows = packets.select("src_ip", "us", "dst_port", "packet_size").repartition("src_ip").sortWithinPartitions("src_ip", "us")
    return rows.mapInPandas(run, "src_ip string, us long, dst_port int, packet_size int, fired_us long")
