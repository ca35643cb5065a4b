"""Fixed values that results depend on: names, labels, weights, thresholds, texts."""

# Feature contract: 22 flow features, in model order.
FLOW_FEATURES = [
    "Flow Duration",
    "Total Fwd Packets",
    "Total Backward Packets",
    "Total Length of Fwd Packets",
    "Total Length of Bwd Packets",
    "Fwd Packet Length Mean",
    "Bwd Packet Length Mean",
    "Flow Bytes/s",
    "Flow Packets/s",
    "Flow IAT Mean",
    "Flow IAT Std",
    "Fwd IAT Mean",
    "Bwd IAT Mean",
    "Fwd PSH Flags",
    "Bwd PSH Flags",
    "Fwd Header Length",
    "Bwd Header Length",
    "Packet Length Mean",
    "Packet Length Std",
    "SYN Flag Count",
    "ACK Flag Count",
    "Down/Up Ratio",
]

# Raw dataset label -> behaviour class; anything else is OTHER.
LABEL_CLASSES = {
    "BENIGN": "BENIGN",
    "DoS Hulk": "DOS",
    "DoS GoldenEye": "DOS",
    "DoS slowloris": "DOS",
    "DoS Slowhttptest": "DOS",
    "DDoS": "DDOS",
    "PortScan": "PORT_SCAN",
    "FTP-Patator": "BRUTE_FORCE",
    "SSH-Patator": "BRUTE_FORCE",
    "Bot": "BOT",
    "Heartbleed": "HEARTBLEED",
}
# The evaluation taxonomy has no class for the label with too few samples.
EVALUATION_LABEL_CLASSES = {k: v for k, v in LABEL_CLASSES.items() if k != "Heartbleed"}
OTHER_CLASS = "OTHER"

SEVERITY_WEIGHTS = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}

# Node type -> display colour; unknown types get the default.
NODE_COLOURS = {
    "RECONNAISSANCE": "#ff0000",
    "UNKNOWN_BEHAVIOR": "#ff8800",
    "MULTI_STAGE_ACTIVITY": "#800080",
    "SUSPICIOUS": "#ffa500",
    "BENIGN": "#008000",
}
DEFAULT_NODE_COLOUR = "#808080"
NODE_LABEL_LENGTH = 18
# Node type -> colour in the force-directed view.
VIEW_COLOURS = {
    "SOURCE": "#ef4444",
    "DESTINATION": "#10b981",
    "UNKNOWN_BEHAVIOR": "#a855f7",
    "INCIDENT": "#facc15",
}
DEFAULT_VIEW_COLOUR = "#3b82f6"

# Packet text columns, in file order.
PACKET_FIELDS_14 = [
    "frame.time_epoch",
    "ip.src",
    "ip.dst",
    "tcp.srcport",
    "tcp.dstport",
    "udp.srcport",
    "udp.dstport",
    "ip.proto",
    "frame.len",
    "tcp.flags.syn",
    "tcp.flags.ack",
    "tcp.flags.push",
    "ip.hdr_len",
    "tcp.hdr_len",
]
PACKET_FIELDS_9 = PACKET_FIELDS_14[:9]
PACKET_FIELDS_8 = [
    "frame.time_epoch",
    "ip.src",
    "ipv6.src",
    "ip.dst",
    "ipv6.dst",
    "tcp.srcport",
    "tcp.dstport",
    "frame.len",
]

# Default thresholds.
FLOW_WINDOW_SECONDS = 5
CORRELATION_WINDOW_SECONDS = 60
MIN_PORTS = 5
MIN_DESTINATIONS = 3
MIN_REPEATS = 2
MIN_BEHAVIOURS = 2
HIGH_CONFIDENCE = 0.90
KNOWN_THREAT_CONFIDENCE = 0.70
CONTAMINATION = 0.05
TREES = 150
TREE_DEPTH = 20
SEED = 42
DBSCAN_EPS = 1.5
DBSCAN_MIN_SAMPLES = 3
BENIGN_SAMPLE = 100_000
HEAD_ROWS = 100
TRAIN_FRACTION = 0.70
TEST_FRACTION = 0.20
MAX_BODY_BYTES = 4096
MAX_AGE_SECONDS = 30
MAX_AHEAD_SECONDS = 10
COMMAND_GAP_SECONDS = 15
COMMAND_LIFETIME_SECONDS = 10
MAX_COMMAND_SECONDS = 5
TIMELINE_LIMIT = 200
TIMELINE_GROUP_PERCENT = 4
TIME_FILTERS = {"1H": 3600, "6H": 21600, "24H": 86400, "7D": 604800}
ACK_OUTCOMES = ["COMPLETED_OFF", "REJECTED", "FAILED_OFF"]

# Evidence and report texts.
RECON_METHOD = "Temporal and behavioral correlation of suspicious network events"
RECON_REASON = (
    "Multiple suspicious connections to multiple ports or destinations within correlation window"
)
MULTI_METHOD = "Cross-behavior temporal correlation with repeated evidence"
PATTERN_METHOD = "IsolationForest + DBSCAN"
REPORT_TEXTS = {
    "RECONNAISSANCE": {
        "inference": "The observed connection pattern is consistent with reconnaissance "
        "or port-scanning activity.",
        "limitation": "Behavioral network evidence indicates suspicious activity but does not "
        "by itself prove attacker intent.",
    },
    "UNKNOWN_BEHAVIOR": {
        "inference": "A previously unseen behavioral pattern was detected among anomalous "
        "network observations. The pattern may represent previously unrecognized activity "
        "and requires analyst validation.",
        "limitation": "The unknown pattern is not automatically classified as malicious. "
        "Additional evidence or analyst validation is required.",
    },
    "MULTI_STAGE_ACTIVITY": {
        "inference": "Multiple suspicious behaviors were observed from the same source. Their "
        "temporal relationship may indicate related stages of a cyber incident.",
        "limitation": "Correlation between behaviors does not prove that they belong to the "
        "same attack. Additional evidence is required.",
    },
    "OTHER": {
        "inference": "The observed network behavior is considered suspicious based on the "
        "detection and correlation pipeline.",
        "limitation": "Network metadata alone may not establish attacker intent.",
    },
}
