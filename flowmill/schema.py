"""The raw flow schema and its column roles.

Columns are addressed by name only; the order of a file never matters.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Names of the flow format, as they stand in its files.
HEAVY_TAILED = (
    "IN_BYTES", "OUT_BYTES", "IN_PKTS", "OUT_PKTS", "FLOW_DURATION_MILLISECONDS", "DURATION_IN", "DURATION_OUT", "SRC_TO_DST_SECOND_BYTES",
    "DST_TO_SRC_SECOND_BYTES", "SRC_TO_DST_AVG_THROUGHPUT", "DST_TO_SRC_AVG_THROUGHPUT", "RETRANSMITTED_IN_BYTES", "RETRANSMITTED_IN_PKTS",
    "RETRANSMITTED_OUT_BYTES", "RETRANSMITTED_OUT_PKTS", "SRC_TO_DST_IAT_MIN", "SRC_TO_DST_IAT_MAX", "SRC_TO_DST_IAT_AVG", "SRC_TO_DST_IAT_STDDEV",
    "DST_TO_SRC_IAT_MIN", "DST_TO_SRC_IAT_MAX", "DST_TO_SRC_IAT_AVG", "DST_TO_SRC_IAT_STDDEV",
)
BOUNDED = (
    "MIN_TTL", "MAX_TTL", "LONGEST_FLOW_PKT", "SHORTEST_FLOW_PKT", "MIN_IP_PKT_LEN", "MAX_IP_PKT_LEN", "TCP_WIN_MAX_IN", "TCP_WIN_MAX_OUT",
    "ICMP_TYPE", "ICMP_IPV4_TYPE", "DNS_QUERY_ID", "DNS_QUERY_TYPE", "DNS_TTL_ANSWER", "FTP_COMMAND_RET_CODE",
)
PACKET_BINS = (
    "NUM_PKTS_UP_TO_128_BYTES", "NUM_PKTS_128_TO_256_BYTES", "NUM_PKTS_256_TO_512_BYTES", "NUM_PKTS_512_TO_1024_BYTES", "NUM_PKTS_1024_TO_1514_BYTES",
)
FLAG_COLUMNS = ("TCP_FLAGS", "CLIENT_TCP_FLAGS", "SERVER_TCP_FLAGS")
FLAG_BITS = ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR")
TIMES = ("FLOW_START_MILLISECONDS", "FLOW_END_MILLISECONDS")
ADDRESSES = ("IPV4_SRC_ADDR", "IPV4_DST_ADDR")
PORTS = ("L4_SRC_PORT", "L4_DST_PORT")
CATEGORICAL = {"PROTOCOL": 8, "L7_PROTO": 16, "L4_DST_PORT": 32}  # with the size of their top-k vocabulary
LABELS = ("Label", "Attack")

#: Days of 2014-01-01 to 2020-01-01, the plausible range of start times, in ms.
VALID_MS = (1_388_534_400_000, 1_577_836_800_000)
#: Below this many distinct sources, addresses alone are no usable node names.
MIN_SOURCES = 1_000
#: Classes below are kept whole when a table is thinned / get no prototype.
MINORITY_ROWS, MIN_PROTOTYPE_ROWS = 200_000, 100

_DOUBLE = (
    "IN_BYTES", "OUT_BYTES", "FLOW_DURATION_MILLISECONDS", "DURATION_IN", "DURATION_OUT", "SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES",
    "SRC_TO_DST_AVG_THROUGHPUT", "DST_TO_SRC_AVG_THROUGHPUT", "RETRANSMITTED_IN_BYTES", "RETRANSMITTED_OUT_BYTES", "SRC_TO_DST_IAT_MIN",
    "SRC_TO_DST_IAT_MAX", "SRC_TO_DST_IAT_AVG", "SRC_TO_DST_IAT_STDDEV", "DST_TO_SRC_IAT_MIN", "DST_TO_SRC_IAT_MAX", "DST_TO_SRC_IAT_AVG",
    "DST_TO_SRC_IAT_STDDEV",
)
RAW_FEATURES = tuple(dict.fromkeys([*TIMES, *ADDRESSES, *PORTS, "PROTOCOL", "L7_PROTO", *HEAVY_TAILED, *FLAG_COLUMNS, *BOUNDED, *PACKET_BINS]))


def _type(name: str) -> T.DataType:
    if name in TIMES:
        return T.LongType()
    if name in ADDRESSES or name == "Attack":
        return T.StringType()
    return T.DoubleType() if name in _DOUBLE else T.IntegerType()


FLOW_SCHEMA = T.StructType([T.StructField(n, _type(n)) for n in (*RAW_FEATURES, *LABELS)])
