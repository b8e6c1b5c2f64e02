"""Column names, label families, ports, thresholds and weights that results depend on."""

# The 41 connection features in file order, then label and difficulty.
COLUMNS = (
    "duration protocol_type service flag src_bytes dst_bytes land wrong_fragment urgent hot num_failed_logins logged_in num_compromised "
    "root_shell su_attempted num_root num_file_creations num_shells num_access_files num_outbound_cmds is_host_login is_guest_login count "
    "srv_count serror_rate srv_serror_rate rerror_rate srv_rerror_rate same_srv_rate diff_srv_rate srv_diff_host_rate dst_host_count "
    "dst_host_srv_count dst_host_same_srv_rate dst_host_diff_srv_rate dst_host_same_src_port_rate dst_host_srv_diff_host_rate "
    "dst_host_serror_rate dst_host_srv_serror_rate dst_host_rerror_rate dst_host_srv_rerror_rate label difficulty"
).split()
CATEGORICAL = ["protocol_type", "service", "flag"]
NUMERIC = [c for c in COLUMNS if c not in (*CATEGORICAL, "label", "difficulty")]
DERIVED = (
    "log_src_bytes log_dst_bytes byte_ratio bytes_per_second conn_per_second error_pressure service_entropy_proxy auth_pressure "
    "service_freq flag_serror flag_rerror proto_tcp proto_udp proto_icmp"
).split()
CODES = ["protocol_type_code", "service_code", "flag_code"]
FEATURES = [*NUMERIC, *DERIVED, *CODES]

# Attack labels by category; unmapped labels are "unknown" and count as attacks.
FAMILIES = {
    "dos": "back land neptune pod smurf teardrop apache2 udpstorm processtable mailbomb".split(),
    "probe": "ipsweep nmap portsweep satan mscan saint".split(),
    "r2l": (
        "ftp_write guess_passwd imap multihop phf spy warezclient warezmaster sendmail named snmpgetattack snmpguess xlock xsnoop httptunnel worm"
    ).split(),
    "u2r": "buffer_overflow loadmodule perl rootkit ps sqlattack xterm".split(),
}
CATEGORIES = ["normal", "dos", "probe", "r2l", "u2r"]
CATEGORY_OF = {label: c for c, labels in FAMILIES.items() for label in labels} | {"normal": "normal", "benign": "normal"}
NOVEL = "apache2 httptunnel mailbomb mscan named processtable ps saint sendmail snmpgetattack snmpguess sqlattack udpstorm worm xlock xsnoop xterm".split()
FLOW_CSV_CATEGORY = {
    "benign": "normal", "portscan": "probe", "dos hulk": "dos", "dos goldeneye": "dos", "dos slowloris": "dos", "dos slowhttptest": "dos", "ddos": "dos", "heartbleed": "dos",
    "ftp-patator": "r2l", "ssh-patator": "r2l", "web attack  brute force": "r2l", "web attack  xss": "r2l", "web attack  sql injection": "r2l", "infiltration": "u2r", "bot": "u2r",
}

# Services by port, TCP flag bits, connection states.
SERVICE_OF_PORT = {
    20: "ftp_data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 43: "whois", 53: "domain", 79: "finger", 80: "http", 110: "pop_3", 111: "sunrpc", 113: "auth",
    119: "nntp", 143: "imap4", 161: "private", 389: "ldap", 443: "http_443", 445: "private", 513: "login", 514: "shell", 515: "printer", 3306: "sql_net", 3389: "other",
    8080: "http_8001",
}
FIN, SYN, RST, ACK, URG = 1, 2, 4, 16, 32
HALF_OPEN = ["s0", "s1", "s2", "s3"]
REJECTED = ["rej", "rsto", "rstr"]
REJECTED_WIDE = ["rej", "rsto", "rstr", "rstos0", "oth"]

# Severity ranks and scores, fusion weights and bands.
SEVERITY_ORDER = ["info", "low", "medium", "high", "critical"]
RULE_SCORE = {"critical": 0.95, "high": 0.85, "medium": 0.65, "low": 0.50}
LAYERS = ["signature", "supervised", "anomaly"]
LAYER_WEIGHT = {"signature": 1.00, "supervised": 0.90, "anomaly": 0.60}
ALONE = {"signature": 0.62, "supervised": 0.55, "anomaly": 0.45}
BANDS = [(0.85, "critical"), (0.65, "high"), (0.45, "medium")]
SUPERVISED_THRESHOLD, ANOMALY_PERCENTILE = 0.5, 99.0
SEED = 20260826

# Which feature belongs to which group; importances and explanations are told by group.
FEATURE_GROUPS = {
    "volume": "src_bytes dst_bytes duration byte_ratio bytes_per_second log_src_bytes log_dst_bytes".split(),
    "connection_rate": "count srv_count dst_host_count dst_host_srv_count conn_per_second".split(),
    "error_behaviour": (
        "serror_rate srv_serror_rate rerror_rate srv_rerror_rate dst_host_serror_rate dst_host_srv_serror_rate dst_host_rerror_rate "
        "dst_host_srv_rerror_rate error_pressure"
    ).split(),
    "service_spread": (
        "same_srv_rate diff_srv_rate srv_diff_host_rate dst_host_same_srv_rate dst_host_diff_srv_rate dst_host_same_src_port_rate "
        "dst_host_srv_diff_host_rate service_entropy_proxy"
    ).split(),
    "authentication": (
        "num_failed_logins logged_in is_guest_login is_host_login root_shell su_attempted num_root hot num_compromised num_file_creations "
        "num_shells num_access_files auth_pressure"
    ).split(),
    "protocol": "protocol_type service flag land wrong_fragment urgent num_outbound_cmds".split(),
}
GROUP_MEANING = {
    "volume": "How much was sent, and how fast: floods and bulk transfers stand apart from sessions.",
    "connection_rate": "How often the host or service was contacted just before: scans and floods.",
    "error_behaviour": "How many of those connections failed: closed ports and exhausted backlogs.",
    "service_spread": "Over how many services or hosts they spread: sweeps against single targets.",
    "authentication": "Failed logins, guest access and root activity inside the session.",
    "protocol": "Protocol, service and connection state.",
    "derived": "Computed from several raw features.",
    "other": "A raw feature of the connection record.",
}


def group_of(feature: str) -> str:
    base = feature.removesuffix("_code")
    for group, members in FEATURE_GROUPS.items():
        if feature in members or base in members:
            return group
    return "derived" if feature in DERIVED else "other"


def meaning_of(feature: str) -> str:
    return GROUP_MEANING[group_of(feature)]
