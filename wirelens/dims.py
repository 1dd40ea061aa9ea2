"""Registries, vocabularies and thresholds.

All tables here are small and constant in size, so joining them by broadcast or
inlining them as literals does not depend on the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRAFFIC_CLASSES = ["email", "file_transfer", "icmp", "messaging", "video", "voip", "web"]

SEVERITIES = ["critical", "high", "medium", "low", "informational"]

CATEGORY_CAPS = {
    "cryptographic_strength": 30,
    "key_exchange": 20,
    "protocol_version_mode": 15,
    "key_management": 15,
    "replay_integrity": 10,
    "metadata_exposure": 10,
}

TECHNIQUES = {
    "T1040": ("Network Sniffing", ["Credential Access", "Discovery"]),
    "T1110": ("Brute Force", ["Credential Access"]),
    "T1557": ("Adversary-in-the-Middle", ["Collection", "Credential Access"]),
    "T1600": ("Weaken Encryption", ["Defense Evasion"]),
}

# ESP suites: name, iv bytes, icv bytes, block bytes, encryption, integrity.
SUITES = [
    ("AES-CBC + HMAC-SHA1-96", 16, 12, 16, "aes-cbc", "hmac-sha1-96"),
    ("AES-CBC + HMAC-SHA256-128", 16, 16, 16, "aes-cbc", "hmac-sha256-128"),
    ("AES-CBC + HMAC-SHA384-192", 16, 24, 16, "aes-cbc", "hmac-sha384-192"),
    ("AES-GCM-16", 8, 16, 4, "aes-gcm-16", "none"),
    ("AES-GCM-8", 8, 8, 4, "aes-gcm-8", "none"),
    ("AES-CTR + HMAC-SHA1-96", 8, 12, 4, "aes-ctr", "hmac-sha1-96"),
    ("3DES-CBC + HMAC-SHA1-96", 8, 12, 8, "3des-cbc", "hmac-sha1-96"),
    ("ChaCha20-Poly1305", 8, 16, 4, "chacha20-poly1305", "none"),
]

# Diffie-Hellman group -> public value bytes.
DH_PUBLIC_BYTES = {1: 96, 2: 128, 5: 192, 14: 256, 15: 384, 16: 512, 19: 64, 20: 96, 21: 132}
ECP_GROUPS = [19, 20, 21]
KE_HEADER_BYTES = 8

# IANA / RFC 2409 / RFC 7296 registries: (version, kind) -> id -> name.
TRANSFORM_IDS = {
    ("ikev2", "encr"): {
        1: "des-cbc",
        3: "3des-cbc",
        11: "null",
        12: "aes-cbc",
        13: "aes-ctr",
        14: "aes-ccm-8",
        15: "aes-ccm-12",
        16: "aes-ccm-16",
        18: "aes-gcm-8",
        19: "aes-gcm-12",
        20: "aes-gcm-16",
        28: "chacha20-poly1305",
    },
    ("ikev2", "prf"): {
        1: "hmac-md5",
        2: "hmac-sha1",
        4: "aes128-xcbc",
        5: "hmac-sha256",
        6: "hmac-sha384",
        7: "hmac-sha512",
        8: "aes128-cmac",
    },
    ("ikev2", "integ"): {
        0: "none",
        1: "hmac-md5-96",
        2: "hmac-sha1-96",
        5: "aes-xcbc-96",
        8: "aes-cmac-96",
        12: "hmac-sha256-128",
        13: "hmac-sha384-192",
        14: "hmac-sha512-256",
    },
    ("ikev1", "encr"): {1: "des-cbc", 5: "3des-cbc", 7: "aes-cbc"},
    ("ikev1", "hash"): {
        1: "hmac-md5-96",
        2: "hmac-sha1-96",
        4: "hmac-sha256-128",
        5: "hmac-sha384-192",
        6: "hmac-sha512-256",
    },
    ("ikev1", "auth"): {1: "psk", 2: "dss_sig", 3: "rsa_sig", 9: "ecdsa_sig"},
}

FIXED_KEY_BITS = {"des-cbc": 56, "3des-cbc": 168}
WEAK_FAMILY_RANK = {"null": 0, "des-cbc": 1, "3des-cbc": 2, "unknown": -1}
STRONG_FAMILY_RANK = 3

# Transform types and IKEv1 attribute numbers.
TF_ENCR, TF_PRF, TF_INTEG, TF_DH, TF_ESN, TF_V1 = 1, 2, 3, 4, 5, -1
AT_V1_ENCR, AT_V1_HASH, AT_V1_AUTH, AT_V1_GROUP = 1, 2, 3, 4
AT_V1_LIFE_TYPE, AT_V1_LIFE_DURATION, AT_KEY_LENGTH = 11, 12, 14
LIFE_TYPE_SECONDS = 1

# File-name stem -> traffic class; ordered, first match wins.
NAME_LABELS = [
    (r"(?:^|[_-])(?:aim|icq|facebook|hangout|skype)[_-]?chat", "messaging"),
    (r"(?:^|[_-])(?:skype|ftps?|sftp|scp)[_-]?(?:file|transfer)", "file_transfer"),
    (r"(?:^|[_-])(?:voipbuzz|voip)", "voip"),
    (r"(?:^|[_-])(?:skype|hangouts?|facebook)[_-]?(?:audio|voice|call)", "voip"),
    (r"(?:^|[_-])(?:skype|hangouts?|facebook)[_-]?video", "video"),
    (r"(?:^|[_-])(?:youtube|netflix|vimeo|spotify)", "video"),
    (r"(?:^|[_-])(?:email|gmail|pop|imap|smtp)", "email"),
    (r"(?:^|[_-])(?:ftps?|sftp|scp|torrent|bittorrent)", "file_transfer"),
    (r"(?:^|[_-])(?:icq|aim|hangouts?|chat)", "messaging"),
    (r"(?:^|[_-])(?:browsing|http|https|web)", "web"),
    (r"(?:^|[_-])(?:icmp|ping)", "icmp"),
]

PCAP_MAGICS = ["a1b2c3d4", "a1b23c4d", "d4c3b2a1", "4d3cb2a1", "0a0d0d0a"]

RATING_BANDS = [(80, "strong"), (60, "good"), (40, "fair"), (20, "poor"), (0, "critical")]

PERCENTILES = [10, 25, 50, 75, 90, 99]

# The sixteen provenance-carrying parameters of a security association, in order.
PARAMETERS = [
    ("ike_version", "IKE version", "string"),
    ("ike_exchange_mode", "Exchange mode", "string"),
    ("encryption_alg", "Encryption algorithm", "string"),
    ("encryption_keylen", "Key length (bits)", "int"),
    ("integrity_alg", "Integrity algorithm", "string"),
    ("prf_alg", "Pseudo-random function", "string"),
    ("dh_group", "Diffie-Hellman group", "int"),
    ("operating_mode", "Operating mode", "string"),
    ("pfs_enabled", "Perfect Forward Secrecy", "boolean"),
    ("auth_method", "Authentication method", "string"),
    ("negotiated_lifetime_s", "Negotiated lifetime (s)", "int"),
    ("observed_rekey_s", "Observed rekey interval (s)", "int"),
    ("esn_negotiated", "Extended Sequence Numbers", "boolean"),
    ("replay_sane", "Sequence numbers behave correctly", "boolean"),
    ("nat_traversal", "NAT traversal", "boolean"),
    ("downgrade_available", "Weaker proposal offered", "boolean"),
]

# Parameters two assessments are compared on: all but the observed rekey interval.
COMPARED_FIELDS = [name for name, _, _ in PARAMETERS if name != "observed_rekey_s"]

# Label fields checked against ground truth.
VERIFIED_FIELDS = [
    "ike_version",
    "ike_exchange_mode",
    "encryption_alg",
    "encryption_keylen",
    "integrity_alg",
    "prf_alg",
    "dh_group",
    "operating_mode",
    "pfs_enabled",
    "auth_method",
    "negotiated_lifetime_s",
]

# Parameters that can arrive inferred, and values derived per association.
INFERABLE = [
    "operating_mode",
    "pfs_enabled",
    "replay_sane",
    "observed_rekey_s",
    "encryption_alg",
    "encryption_keylen",
    "integrity_alg",
    "downgrade_available",
]
DERIVED = ["metadata_exposure_confidence", "rekey_observed", "sa_duration_s"]

MODE_FEATURES = [
    "max_len_over_mtu",
    "spi_pairs_per_endpoint",
    "cleartext_ratio",
    "modal_len_offset",
    "min_len_offset",
    "inner_header_bytes",
]


def _stat_names(prefix: str) -> list[str]:
    return [f"{prefix}_{s}" for s in ("mean", "std", "min", "max")] + [
        f"{prefix}_p{p}" for p in PERCENTILES
    ]


# The feature vector's 74 names, in model order.
FEATURES = (
    _stat_names("esp_len")
    + [f"esp_len_mod16_{r}" for r in range(16)]
    + ["esp_len_distinct", "esp_len_modal", "esp_len_modal_share"]
    + ["packet_count", "byte_count", "duration_s", "packets_per_s", "bytes_per_s"]
    + _stat_names("iat")
    + ["iat_cv", "burst_count", "idle_total_s", "idle_mean_s"]
    + ["up_packets", "down_packets", "up_down_byte_ratio", "up_down_packet_ratio"]
    + _stat_names("up_len")
    + _stat_names("down_len")
    + ["sa_spi_count", "sa_paired"]
)

# Padding-geometry features, absent from captures without ESP padding.
NOT_COMPARABLE = [f"esp_len_mod16_{r}" for r in range(16)] + [
    "esp_len_distinct",
    "esp_len_modal",
    "esp_len_modal_share",
]


def lookup(mapping: dict, key: Column, default: Column | None = None) -> Column:
    """A constant map looked up by ``key`` as a CASE expression."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == F.lit(k), F.lit(v)) if expr is None else expr.when(key == F.lit(k), F.lit(v))
    return expr.otherwise(default if default is not None else F.lit(None))


def severity_rank(severity: Column) -> Column:
    return lookup({s: i for i, s in enumerate(SEVERITIES)}, severity)


def transforms(spark: SparkSession) -> DataFrame:
    """(version, kind, id, name): every registry entry as a row."""
    rows = [
        (version, kind, code, name)
        for (version, kind), entries in TRANSFORM_IDS.items()
        for code, name in entries.items()
    ]
    return spark.createDataFrame(rows, "version string, kind string, id int, name string")


def suites(spark: SparkSession) -> DataFrame:
    rows = [(i, *s, s[1] + s[2]) for i, s in enumerate(SUITES)]
    return spark.createDataFrame(
        rows,
        "ordinal int, suite string, iv int, icv int, block int, encryption string, "
        "integrity string, overhead int",
    )


def techniques(spark: SparkSession) -> DataFrame:
    rows = [(t, name, tactics) for t, (name, tactics) in TECHNIQUES.items()]
    return spark.createDataFrame(
        rows, "technique_id string, technique_name string, tactics array<string>"
    )


def traffic_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in TRAFFIC_CLASSES], "traffic_class string")


def dh_sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DH_PUBLIC_BYTES.items()), "dh_group int, public_bytes int")
