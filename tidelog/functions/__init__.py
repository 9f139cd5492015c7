from .iocs import INDICATORS, plausible_domain, private_ipv4, valid_ipv4
from .text import basename, first_token, norm, printable_hex, tokens, unquote
from .times import bucket_start, parse_time

__all__ = ["INDICATORS", "basename", "bucket_start", "first_token", "norm", "parse_time", "plausible_domain", "printable_hex", "private_ipv4", "tokens", "unquote", "valid_ipv4"]
