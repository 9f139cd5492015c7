from .json_logs import flatten, normalize, read_json
from .sinks import verify_files, write_csv, write_json
from .sniff import sniff
from .syslog import merge_audit, parse_syslog, read_syslog

__all__ = ["flatten", "merge_audit", "normalize", "parse_syslog", "read_json", "read_syslog", "sniff", "verify_files", "write_csv", "write_json"]
