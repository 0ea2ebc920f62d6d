"""Names, numbers and lookup tables that results depend on."""

EPS = 1e-6
FIRST_CONTACT_SECONDS = 86400

# --- fixed values: label taxonomies (class 0 is always BENIGN) -----------------
TAXONOMY_CLASSES = {
    "cicids6": ["BENIGN", "DDoS", "PortScan", "Botnet", "SSHBrute", "DoSHulk"],
    "grouped": ["BENIGN", "DDoS", "PortScan", "Botnet", "BruteForce", "DoS"],
    "flood4": ["BENIGN", "Volumetric_Flood", "PortScan", "BruteForce", "Botnet"],
}
TAXONOMY_LABELS = {
    "cicids6": {
        "BENIGN": "BENIGN",
        "DDoS": "DDoS",
        "PortScan": "PortScan",
        "Bot": "Botnet",
        "SSH-Patator": "SSHBrute",
        "DoS Hulk": "DoSHulk",
    },
    "grouped": {
        "BENIGN": "BENIGN",
        "DDoS": "DDoS",
        "PortScan": "PortScan",
        "Bot": "Botnet",
        "FTP-Patator": "BruteForce",
        "SSH-Patator": "BruteForce",
        "DoS Hulk": "DoS",
        "DoS GoldenEye": "DoS",
        "DoS slowloris": "DoS",
        "DoS Slowhttptest": "DoS",
    },
    "flood4": {
        "BENIGN": "BENIGN",
        "DDoS": "Volumetric_Flood",
        "DoS Hulk": "Volumetric_Flood",
        "DoS GoldenEye": "Volumetric_Flood",
        "DoS slowloris": "Volumetric_Flood",
        "DoS Slowhttptest": "Volumetric_Flood",
        "PortScan": "PortScan",
        "FTP-Patator": "BruteForce",
        "SSH-Patator": "BruteForce",
        "Bot": "Botnet",
    },
}
NON_MODEL_LABELS = ["Manual", "Heuristic", "Unknown"]

# --- fixed values: port and protocol vocabulary --------------------------------
NAMED_PORTS = [
    21, 22, 23, 25, 53, 67, 68, 69, 80, 110, 111, 115, 123, 135, 137, 138, 139, 143,
    161, 162, 389, 443, 445, 465, 500, 512, 513, 514, 515, 520, 587, 631, 636, 873,
    989, 990, 993, 995, 1080, 1194, 1433, 1521, 1701, 1723, 1883, 1900, 2049, 2181,
    2375, 2376, 3000, 3128, 3306, 3389, 4444, 4500, 5000, 5060, 5061, 5432, 5555,
    5672, 5900, 5984, 5985, 5986, 6379, 6443, 6660, 6666, 6667, 6697, 7000, 8000,
    8080, 8081, 8291, 8443, 8888, 9042, 9090, 9092, 9200, 10250, 11211, 12345, 27017,
    31337, 49152,
]
PORT_UNKNOWN_TOKEN = 1
PORT_FIRST_TOKEN = 2
PORT_BUCKET_EDGES = [0, 1, 512, 1024, 2048, 4096, 8192, 16384, 32768, 49152, 65536]
PROTOCOL_TOKENS = {0: 1, 1: 2, 6: 3, 17: 4, 47: 5, 50: 6}
PROTOCOL_UNKNOWN_TOKEN = 7
PROTOCOL_NUMBERS = {"TCP": 6, "UDP": 17, "ICMP": 1, "IP": 0, "ARP": 0}
TCP_FLAG_BITS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32}

# --- fixed values: feature names ------------------------------------------------
EDGE_FEATURES = [
    "log_duration_s", "log_total_packets", "log_total_bytes", "fwd_packet_ratio",
    "byte_asymmetry", "avg_packet_size", "log_max_fwd_len", "log_max_bwd_len",
    "syn_ratio", "rst_ratio", "ack_ratio", "psh_ratio", "log_iat_mean",
    "iat_burstiness", "log_dt_since_pair", "log_dt_since_src", "window_position",
    "direction_flag", "log_bytes_per_s", "log_packets_per_s",
]
VOLUMETRIC_FEATURES = ["log_bytes_per_s", "log_packets_per_s"]
NODE_FEATURES = [
    "log_out_degree", "log_in_degree", "degree_ratio", "log_unique_dst_ips",
    "log_unique_src_ips", "log_unique_dst_ports", "dst_port_entropy", "peer_entropy",
    "reciprocity", "log_total_bytes_out", "log_total_bytes_in", "mean_inter_flow_dt",
    "std_inter_flow_dt", "is_private_addr", "log_windows_seen", "burst_score",
]

# --- fixed values: mitigation policy per class ----------------------------------
# class, action, idle, hard, priority, min_conf, meter_kbps
POLICY_ROWS = [
    ("Volumetric_Flood", "meter", 60, 600, 40000, 0.90, 1000),
    ("PortScan", "alert_only", 30, 300, 45000, 0.85, None),
    ("BruteForce", "drop_port", 120, 1800, 48000, 0.85, None),
    ("Botnet", "alert_only", 0, 0, 0, 1.01, None),
]
POLICY_SCHEMA = (
    "attack_class string, action string, idle int, hard int, priority int, "
    "min_conf double, meter_kbps int"
)
MAX_RULES_PER_WINDOW = 50

# --- fixed values: timestamp formats, tried over a whole column -----------------
TIMESTAMP_FORMATS = [
    "d/M/yyyy H:m:s", "d/M/yyyy H:m", "d/M/yyyy h:m:s a", "d/M/yyyy h:m a",
    "M/d/yyyy H:m:s", "M/d/yyyy H:m",
]
MERIDIEM_PATTERN = r"(?i)\b[ap]\.?m\b"

# --- fixed values: CSV header spellings -> canonical column ---------------------
HEADER_ALIASES = {
    "src ip": "src_ip", "source ip": "src_ip", "src_ip": "src_ip", "srcip": "src_ip",
    "dst ip": "dst_ip", "destination ip": "dst_ip", "dst_ip": "dst_ip", "dstip": "dst_ip",
    "src port": "src_port", "source port": "src_port", "src_port": "src_port",
    "dst port": "dst_port", "destination port": "dst_port", "dst_port": "dst_port",
    "protocol": "protocol", "proto": "protocol",
    "timestamp": "timestamp", "flow id": "flow_id", "label": "label",
    "flow duration": "duration_us",
    "total fwd packets": "fwd_packets", "total backward packets": "bwd_packets",
    "total length of fwd packets": "fwd_bytes", "total length of bwd packets": "bwd_bytes",
    "fwd packet length max": "fwd_len_max", "bwd packet length max": "bwd_len_max",
    "flow iat mean": "iat_mean", "fwd iat total": "fwd_iat", "bwd iat total": "bwd_iat",
    "syn flag count": "syn", "rst flag count": "rst", "ack flag count": "ack",
    "psh flag count": "psh",
    "flow bytes/s": "bytes_per_s", "flow packets/s": "packets_per_s",
}
STRUCTURAL_COLUMNS = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "timestamp", "label"]
FEATURE_COLUMNS = [
    "duration_us", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "fwd_len_max",
    "bwd_len_max", "iat_mean", "fwd_iat", "bwd_iat", "syn", "rst", "ack", "psh",
]
RATE_COLUMNS = ["bytes_per_s", "packets_per_s"]

# --- fixed values: host status -> state, alert grid, service limits -------------
STATE_OF_STATUS = {
    "normal": "healthy", "suspicious": "watching", "infected": "watching",
    "malicious": "threat", "attacking": "threat", "isolated": "contained",
    "blocked": "contained",
}
ALERT_FLOW_COUNTS = [1, 2, 3, 5, 10, 25, 50, 100]
FIXED_THRESHOLDS = [0.5, 0.8, 0.85, 0.9, 0.95, 0.99]
CONFIGURED_HOSTS = [f"10.0.0.{i}" for i in range(1, 11)]

# --- fixed values: incident types, timeline spans and steps in minutes ----------
KNOWN_TYPES = ["DDoS", "PortScan", "SSHBrute", "Botnet", "DoSHulk", "Manual", "Heuristic", "Unknown"]
WINDOW_STEPS = {"all": (43200, 1440), "30d": (43200, 1440), "14d": (20160, 720), "7d": (10080, 360),
                "24h": (1440, 60), "6h": (360, 15), "1h": (60, 5), "60min": (60, 5)}
STEP_LIMITS = [(60, 5), (360, 15), (1440, 60), (10080, 360), (20160, 720), (43200, 1440)]
