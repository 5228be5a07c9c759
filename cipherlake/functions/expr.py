"""Column expressions over flow tables; all but one are native Spark expressions."""

from __future__ import annotations

import hashlib
import ipaddress
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Protocol numbers, names that mark encrypted rows, words for missing values.
PROTOCOLS = {"tcp": 6, "udp": 17, "icmp": 1}
TLS_SIGNALS = ("version", "cipher", "server_name", "ja3", "ja3s")
QUIC_TOKENS = ("quic", "cid", "scid", "dcid", "h3", "http3")
MISSING_WORDS = ("nan", "none", "null")
TRUNCATION_MARKERS = ("appears to have been cut short", "cut short in the middle of a packet", "middle of a packet")

# Which part of a name tells which service, first match first.
SERVICES = {
    "instagram": "Instagram",
    "facebook": "Facebook",
    "fbstatic": "Facebook CDN",
    "fbcdn": "Facebook CDN",
    "twitter": "Twitter",
    "doubleclick": "DoubleClick",
    "google": "Google",
    "gstatic": "Google Static",
    "gmail": "Google Mail",
    "youtube": "YouTube",
    "qiwi": "Qiwi",
    "yandex": "Yandex",
    "marathonbet": "Marathonbet",
    "bebee": "beBee",
    "pusher": "Pusher",
    "indeed": "Indeed",
    "newrelic": "New Relic",
    "mail.ru": "Mail.ru",
    "akamai": "Akamai Edge",
    "amazonaws": "Amazon AWS",
    "alibaba": "Alibaba",
    "microsoft": "Microsoft",
    "playstation": "PlayStation",
    "cloudflare": "Cloudflare",
}
# Labels of a domain that say nothing about the service.
COMMON_LABELS = ("www", "api", "static", "cdn", "mail", "m", "ws", "csp", "ogads-pa", "clients6", "stats", "mc", "main")
# Names shown for well-known hosts.
HOST_NAMES = {
    "translate.google.com": "Google Translate",
    "accounts.google.com": "Google Accounts",
    "apis.google.com": "Google APIs",
    "mail.google.com": "Google Mail",
    "api.instagram.com": "Instagram API",
    "twitter.com": "Twitter",
    "static.qiwi.com": "Qiwi Static Services",
    "bam.nr-data.net": "New Relic Beacon",
    "mc.yandex.ru": "Yandex Analytics",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which stands and is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def first_case(cases: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first test that holds."""
    return F.coalesce(*(F.when(test, value) for test, value in cases), otherwise)


def numeric(column: Column) -> Column:
    """Text or number as double; what isn't a finite number is null."""
    value = column.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def is_present(column: Column) -> Column:
    """Whether a value is there: not null, blank or a word for a missing value."""
    text = F.lower(F.trim(column.cast("string")))
    return F.coalesce(~text.isin("", *MISSING_WORDS), F.lit(False))


def clean_text(column: Column) -> Column:
    """Trimmed text; missing values as the empty string."""
    return F.when(is_present(column), F.trim(column.cast("string"))).otherwise("")


def truthy(column: Column) -> Column:
    """A boolean that may have been written as text."""
    return F.coalesce(F.lower(F.trim(column.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def number_or(column: Column, default: float | None) -> Column:
    """A number with null, NaN and unreadable text replaced by ``default``."""
    return F.coalesce(numeric(column), F.lit(default).cast("double"))


def protocol_number(column: Column) -> Column:
    """IP protocol number of a name, null for unknown names."""
    return F.create_map(*(F.lit(x) for pair in PROTOCOLS.items() for x in pair))[F.lower(column)]


def tls_mask(columns: Sequence[str]) -> Column:
    """Rows with any TLS log field."""
    return any_of([F.col(c).isNotNull() for c in columns if c in TLS_SIGNALS])


def quic_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if any(token in c.lower() for token in QUIC_TOKENS)]


def quic_mask(columns: Sequence[str]) -> Column:
    """Rows with a value in any column whose name tells of QUIC."""
    return any_of([F.col(c).isNotNull() for c in quic_columns(columns)])


def encrypted_signal(columns: Sequence[str]) -> Column:
    """Rows with a non-blank TLS or QUIC field: the strict test of the quality gate."""
    return any_of([is_present(F.col(c)) for c in columns if c in TLS_SIGNALS or c in quic_columns(columns)])


def protocol_family(columns: Sequence[str]) -> Column:
    """tls, quic or other: by application name, then TLS version, then QUIC identifiers."""
    name = lambda c: F.upper(F.trim(F.col(c).cast("string"))) if c in columns else F.lit(None).cast("string")
    application, version = name("application_name"), name("version")
    quic = any_of([F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)) for c in ("client_scid", "server_scid", "quic_version") if c in columns])
    cases = [(application.startswith("TLS"), F.lit("tls")), (application.startswith("QUIC"), F.lit("quic")), (version.startswith("TLS"), F.lit("tls")), (quic, F.lit("quic"))]
    return first_case(cases, F.lit("other"))


def record_id(*parts: Column) -> Column:
    """SHA-256 of the parts joined by bars."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def quality_status(failed: Column) -> Column:
    return F.when(failed, "fail").when(~failed, "pass").otherwise("unknown")


def endpoints(a: Column, b: Column) -> tuple[Column, Column]:
    """An unordered pair of addresses, compared as text."""
    return F.least(a, b), F.greatest(a, b)


def is_private_v4(column: Column) -> Column:
    """Whether an IPv4 address is in a range that isn't public; null if it is no IPv4 address."""
    parts = F.split(column, r"\.")
    octet = [F.get(parts, F.lit(i)).try_cast("int") for i in range(4)]
    a, b, c, d = octet
    valid = column.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$") & (a < 256) & (b < 256) & (c < 256) & (d < 256)
    private = a.isin(0, 10, 127) | (a >= 240) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
    special = ((a == 192) & (b == 0) & (c == 2)) | ((a == 192) & (b == 0) & (c == 0) & ~d.isin(9, 10)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    return F.when(valid, private | special)


def is_private_v6(column: Column) -> Column:
    """Whether an IPv6 address, with or without its zeros, is in a range that isn't public; null if it is no IPv6 address."""
    # Groups without leading zeros.
    text = F.regexp_replace(F.lower(column), r"(^|:)0+(?=[0-9a-f])", "$1")
    mapped = is_private_v4(F.regexp_extract(text, r"^(?::|0:0:0:0:0|0::):ffff:([\d.]+)$", 1))
    special = r"^([0:]*:[01]?$|64:ff9b:1:|100:(?::|0::|0:0::|0:0:0:)|2001:db8:|2002:|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|2001:(?!3:|[23][0-9a-f]:|4:112:)(:|[0-9a-f]{1,2}:|1[0-9a-f]{2}:))"
    return F.coalesce(mapped, F.when(text.rlike(r"^(?=.*:.*:)(?!.*::.*::)[0-9a-f]{0,4}(:[0-9a-f]{0,4}){2,7}$"), text.rlike(special)))


def is_private_address(column: Column) -> Column:
    """Whether an address of either kind isn't public, by built-in expressions; null if it is no address."""
    return F.coalesce(is_private_v4(column), is_private_v6(column))


@F.pandas_udf(T.BooleanType())
def is_private(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The same for IPv4 and IPv6, by the registry that Python ships; null for invalid addresses."""

    def one(text: str | None) -> bool | None:
        try:
            return ipaddress.ip_address(text).is_private
        except ValueError:
            return None

    for series in values:
        known = {text: one(text) for text in series.dropna().unique()}
        yield series.map(known).astype("boolean")


def title_case(column: Column) -> Column:
    """First letter of each run of letters upper, the others lower."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(column), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), F.initcap), "")


def service_match(text: Column) -> Column:
    """The service that a name's text tells, null if none."""
    # The text stands once in the expression, inside the lambda, which keeps generated code small.
    part = F.get(F.filter(F.array(*map(F.lit, SERVICES)), lambda p: F.contains(F.lower(text), p)), F.lit(0))
    return F.create_map(*(F.lit(x) for pair in SERVICES.items() for x in pair))[part]


def service_from_domain(domain: Column) -> Column:
    """Service family of a host name: a known one, else its second-level label; empty for no name."""

    def own(text: Column) -> Column:
        """The label before the last of those that tell something, or the only one."""
        told = F.filter(F.split(F.lower(text), r"\."), lambda x: ~x.isin(*COMMON_LABELS) & (F.length(x) > 2))
        return let(told, lambda x: F.when(F.size(x) == 0, "Encrypted Service").otherwise(title_case(F.get(x, F.greatest(F.size(x) - 2, F.lit(0))))))

    return let(clean_text(domain), lambda text: F.when(text == "", "").otherwise(F.coalesce(service_match(text), own(text))))


def service_from_application(application: Column) -> Column:
    """Service family of an application name such as ``TLS.Google``."""

    def named(rest: Column) -> Column:
        plain = F.trim(F.replace(rest, F.lit("_"), F.lit(" ")))
        return F.coalesce(service_match(rest), F.nullif(plain, F.lit("")), F.lit("Encrypted Session"))

    def own(text: Column) -> Column:
        rest = F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"^[^.]*\.", "")).otherwise(text)
        return F.when(text == "", "").when(F.upper(text) == "TLS", "Encrypted Session").when(F.upper(text) == "QUIC", "QUIC Session").otherwise(let(rest, named))

    return let(clean_text(application), own)


def service_family(domain: Column, application: Column) -> Column:
    return F.coalesce(F.nullif(service_from_domain(domain), F.lit("")), F.nullif(service_from_application(application), F.lit("")), F.lit("Encrypted Session"))


def display_service(domain: Column, application: Column) -> Column:
    """A host's shown name, else the application's family."""
    names = F.create_map(*(F.lit(x) for pair in HOST_NAMES.items() for x in pair))
    shown = let(clean_text(domain), lambda host: F.when(host != "", F.coalesce(names[F.lower(host)], host)))
    return F.coalesce(shown, F.nullif(service_from_application(application), F.lit("")), F.lit("Encrypted Session"))


def protocol_label(column: Column) -> Column:
    return F.when(F.lower(clean_text(column)) == "quic", "QUIC").otherwise("TLS")


def window_label(window_id: Column) -> Column:
    """A window's shown name: the kind of its capture and its number from 1."""
    capture = F.lower(F.split(window_id, ":")[0])
    kind = F.when(capture.contains("malicious") | capture.contains("botnet"), "Campaign").when(capture.contains("benign") | capture.contains("lab"), "Baseline").otherwise("Segment")
    number = F.coalesce(F.regexp_extract(window_id, r":.*?w(\d+)", 1).try_cast("int") + 1, F.lit(1))
    text = F.when(number < 100, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string"))
    return F.when(F.coalesce(window_id, F.lit("")) == "", "Window").otherwise(F.concat_ws(" ", kind, text))


def slug(column: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(column), "[^a-z0-9]+", "-"), F.lit("-"))


def dataset_name(column: Column) -> Column:
    """A name that is safe in paths, of at most 120 characters."""
    name = F.substring(F.trim(F.regexp_replace(F.trim(column), "[^A-Za-z0-9._-]+", "-"), F.lit("-._")), 1, 120)
    return F.when(name == "", "capture").otherwise(name)


def weighted_mean(scores: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted mean of several scores of a row."""
    if sum(weights) <= 0:
        raise ValueError("weights must sum to a positive value")
    return reduce(lambda a, b: a + b, (s * float(w) for s, w in zip(scores, weights, strict=True))) / float(sum(weights))


def alert_level(tier1: Column, tier2: Column, passes: Column, models: int, consensus: Column, high: float = 0.9) -> Column:
    sure = lambda c: F.coalesce(c, F.lit(False))
    return F.when(sure(tier2 & (passes >= models) & (consensus >= high)), "high").when(sure(tier2), "medium").when(sure(tier1), "candidate").otherwise("none")


def display_number(column: Column) -> Column:
    """A count with thousands set off."""
    return F.format_number(column, 0)


def display_percent(column: Column) -> Column:
    """A share as a percentage with one decimal."""
    return F.concat(F.format_number(column * 100, 1), F.lit("%"))


def is_truncated(text: Column) -> Column:
    """Whether a tool's message tells of a capture that was cut short."""
    return F.coalesce(any_of([F.lower(text).contains(marker) for marker in TRUNCATION_MARKERS]), F.lit(False))


def artifact_type(path: Column) -> Column:
    """What kind of output a file is, by the end of its name; the order of the rules matters."""
    # Fixed values.
    rules = {
        "_quality_report.json": "quality_report",
        "workflow_summary.json": "workflow_summary",
        "platform_summary.json": "platform_summary",
        "graph_bundle.json": "graph_bundle",
        "suspicious_flows.csv": "suspicious_flows_csv",
        "tiered_flow_scores.csv": "tiered_scores_csv",
        ".png": "plot",
        ".csv": "csv",
        ".json": "json",
        ".pcap": "pcap",
        ".pcapng": "pcap",
    }
    return first_case([(F.lower(path).endswith(end), F.lit(kind)) for end, kind in rules.items()], F.lit("artifact"))


def map_values(column: Column, names: Mapping[str, str]) -> Column:
    """A text replaced by its entry, or left as it is."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[column], column)


def keyed_hash(column: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a text in hexadecimal digits: without the key it can't be found by trying all texts."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in block)), column.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in block)), F.unhex(inner)), 256)
