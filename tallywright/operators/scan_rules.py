"""The rules of the code scans as rows: users add rows of the same shapes.

All patterns are valid for Java and RE2 unless they look ahead.
"""

from __future__ import annotations

from typing import NamedTuple


class LineRule(NamedTuple):
    """A line is hit when `need` and `also` match it and `skip` does not; so do `paths` and `skip_paths` with its file."""

    rule: str
    subtype: str
    need: str
    skip: str = ""
    also: str = ""
    paths: str = r"\.py$"
    skip_paths: str = ""


class NearRule(NamedTuple):
    """A line is hit when `need` and `also` match it and `skip` does not, and the lines from `low` to `high` around it match near_need and not near_skip."""

    rule: str
    subtype: str
    need: str
    low: int
    high: int
    near_need: str = ""
    near_skip: str = ""
    also: str = ""
    paths: str = r"\.py$"
    skip: str = ""


class FileRule(NamedTuple):
    """A file is hit, as often as `need` matches it if `every`, when all of `also` match its text and `skip` does not."""

    rule: str
    subtype: str
    need: str
    also: tuple[str, ...] = ()
    skip: str = ""
    every: bool = False
    paths: str = r"\.py$"


# Names, patterns, severities and confidences that results must agree with.
_JS = r"\.(js|jsx|ts|tsx)$"
_JS_FUNCTION = r"\b(function|const|let|var)\s+\w+\s*=\s*(async\s+)?(\(.*?\)|function)"
_NOT_TESTS = r"(^|/)(__pycache__|\.git|venv|build|dist|tests)/|(^|/)test_[^/]*$"
LINE_RULES = (
    LineRule("sc_secrets", "api_key", r"""(?i)["']?api[_-]?key["']?\s*[=:]\s*["']([^"']+)["']""", paths=""),
    LineRule("sc_secrets", "password", r"""(?i)["']?password["']?\s*[=:]\s*["']([^"']+)["']""", paths=""),
    LineRule("sc_secrets", "token", r"""(?i)["']?token["']?\s*[=:]\s*["']([^"']+)["']""", paths=""),
    LineRule("sc_secrets", "secret", r"""(?i)["']?secret["']?\s*[=:]\s*["']([^"']+)["']""", paths=""),
    LineRule("sc_secrets", "aws_key", r"(?i)AKIA[0-9A-Z]{16}", paths=""),
    LineRule("sc_secrets", "private_key", r"(?i)-----BEGIN PRIVATE KEY-----", paths=""),
    LineRule("sc_sec_patterns", "hardcoded_password", r"""(?i)(password|passwd|pwd)\s*=\s*["'][^"']+["']"""),
    LineRule("sc_sec_patterns", "hardcoded_api_key", r"""(?i)(api[_-]?key|apikey|access[_-]?key)\s*=\s*["'][a-zA-Z0-9]{20,}["']"""),
    LineRule("sc_sec_patterns", "sql_injection", r"""(?i)(execute|cursor\.execute|query)\s*\(\s*["'].*%s.*["'].*%"""),
    LineRule("sc_sec_patterns", "eval_usage", r"(?i)\beval\s*\("),
    LineRule("sc_sec_patterns", "exec_usage", r"(?i)\bexec\s*\("),
    LineRule("sc_sec_patterns", "debug_mode", r"(?i)(DEBUG\s*=\s*True|app\.debug\s*=\s*True)"),
    LineRule("sc_sec_patterns", "weak_crypto", r"(?i)\b(md5|sha1|DES|RC4)\s*\("),
    LineRule("sc_sec_patterns", "missing_csrf_protection", r"(?i)@app\.route.*methods.*POST"),  # without the look-ahead at its end, which never fails
    LineRule("sc_sec_patterns", "insecure_random", r"(?i)\brandom\.(random|randint|choice)\s*\("),
    LineRule("sc_sec_patterns", "path_traversal", r"(?i)(open|read).*\+.*user.*\+"),
    LineRule("sc_sec_patterns", "hardcoded_secret", r"""(?i)(secret[_-]?key|jwt[_-]?secret|encryption[_-]?key)\s*=\s*["'][^"']+["']"""),
    LineRule("sc_sec_patterns", "unsafe_deserialization", r"(?i)(pickle\.loads|yaml\.load)\s*\("),
    LineRule("sc_sec_patterns", "shell_injection", r"(?i)(os\.system|subprocess\.(call|run|Popen))\s*\(.*\+"),
    LineRule("sc_sec_patterns", "open_redirect", r"(?i)redirect\s*\(\s*request\."),
    LineRule("sc_sec_js", "eval", r"\beval\s*\(", paths=_JS),
    LineRule("sc_sec_js", "inner_html", r"\.innerHTML\s*=", paths=_JS),
    LineRule("sc_sec_js", "console", r"console\.(log|debug|info)", paths=_JS),
    LineRule("sc_private_access", "", r"\.\s*_[a-zA-Z_]\w*", r"self\._"),
    LineRule("sc_struct_access", "", r"\.\s*\[|\.get\(|\.keys\(|\.values\("),
    LineRule("sc_impl_types", "", r"->\s*(dict|list|set|tuple)\b"),
    LineRule("sc_type_hints", "", r"^\s*def\s+\w+\(.*\):\s*$", "->"),
    LineRule("sc_docstrings", "", r"^\s*def\s+[a-zA-Z0-9]\w*\(", "\"\"\"|'''"),
    LineRule("sc_no_error_handling", "", r"\.read\(|\.parse|json\.load|requests\.", r"try|\.get\("),
    LineRule("sc_shared_mutable", "", r"self\.\w+\s*=\s*(\[|\{)", "Lock|Queue"),
    LineRule("sc_threads", "", r"Thread\(|threading\.Thread"),
    LineRule("sc_env_usage", "", r"os\.environ|os\.getenv"),
    LineRule("sc_hardcoded", "timeout", r"(?i)timeout\s*=\s*\d+"),
    LineRule("sc_hardcoded", "max", r"(?i)max_\w+\s*=\s*\d+"),
    LineRule("sc_hardcoded", "url", r"""(?i)url\s*=\s*["']http"""),
    LineRule("sc_hardcoded", "host", r"""(?i)host\s*=\s*["']localhost["']"""),
    LineRule("sc_hardcoded", "port", r"(?i)port\s*=\s*\d+"),
    LineRule("sc_env_specific", "", r"(?i)if\s+.*ENVIRONMENT|if\s+.*ENV|if\s+.*=='prod'|if\s+.*=='dev'"),
    LineRule("sc_deprecated", "pkg_resources", r"import\s+pkg_resources|from\s+pkg_resources"),
    LineRule("sc_deprecated", "imp_module", r"import\s+imp\b|from\s+imp\s"),
    LineRule("sc_deprecated", "asyncio_coroutine", r"@asyncio\.coroutine|yield\s+from"),
    LineRule("sc_deprecated", "nose_testing", r"import\s+nose|from\s+nose"),
    LineRule("sc_nplus1_line", "", r"for\s+\w+\s+in", also=r"\.query\(|\.filter\(|\.get\(|\.all\(|db\.session"),
    LineRule("sc_infinite_loop", "", r"while\s+(True|1)\s*:"),
    LineRule("sc_blocking_io", "", r"\.read\(|\.readlines\(|open\("),
    *(LineRule("sc_critical_code", w, f"(?i){w}", skip_paths=_NOT_TESTS) for w in ("payment", "transaction", "security", "password", "token", "auth", "encrypt")),
    LineRule("sc_untested_errors", "", r"except\s+\w+|raise\s+\w+"),
    LineRule("sc_shared_state", "self_list", r"self\.\w+\s*=\s*\[\]"),
    LineRule("sc_shared_state", "self_dict", r"self\.\w+\s*=\s*\{\}"),
    LineRule("sc_shared_state", "self_set", r"self\.\w+\s*=\s*set\(\)"),
    LineRule("sc_shared_state", "list", r"^\w+\s*=\s*\[\]"),
    LineRule("sc_shared_state", "dict", r"^\w+\s*=\s*\{\}"),
    LineRule("sc_null_risks", "dict_access", r"""\w\[(["'][^"']+["'])\](\s*[^\s=]|\s*$)""", r"\.get\(|^[^\[]*="),
    LineRule("sc_null_risks", "list_access", r"\w\[(\d+|[a-zA-Z_]\w*)\](\s*[^\s=]|\s*$)", r"len\(|if "),
    LineRule("sc_null_risks", "chained_call", r"\w\.\w+\(.*?\)\.\w+", "if |try:"),
    LineRule("sc_unhandled", "file_open", r"open\([^)]+\)(?!\s*as\s+\w+:)"),
    LineRule("sc_division", "", r"/\s*[a-zA-Z_]\w*", "!= 0|> 0|if "),
    LineRule("sc_float_eq", "float", "float", "isclose", also="=="),
    LineRule("sc_float_eq", "literal", r"==\s*\d+\.\d+", "isclose"),
    LineRule("sc_timezone", "now", r"datetime\.now\(\)", "timezone|tz="),
    LineRule("sc_timezone", "constructor", r"datetime\(", "tzinfo|timezone"),
    LineRule("sc_retry", "continue", "except", also="continue"),
    LineRule("sc_timeouts", "requests", r"requests\.", "timeout", also=r"\("),
    LineRule("sc_timeouts", "socket", r"socket\.socket\(", "settimeout"),
    LineRule("sc_timeouts", "connect", r"\.connect\(", "timeout"),
    LineRule("sc_silent", "bare", r"^\s*except\s*:\s*$"),
    LineRule("sc_silent", "pass", r"except[^:]*:\s*pass"),
    LineRule("sc_file_leak", "", r"^[^=]*=[^=]*open\(", "with"),
    LineRule("sc_conn_leak", "connect", r"\.connect\(", "with"),
    LineRule("sc_conn_leak", "cursor", r"\.cursor\(", "with"),
    LineRule("sc_conn_leak", "socket", r"socket\.socket\(", "with"),
    LineRule("sc_mem_leak", "cache", r"(cache|memo|store)\s*=\s*\{\}", "^    "),
    LineRule("sc_mem_leak", "list", r"^(\w+)\s*=\s*\[\]"),
    LineRule("sc_thread_leak", "pool", r"ThreadPoolExecutor\(", "with"),
    LineRule("sc_unbounded_query", "select", r"(?i)SELECT.*FROM", "(?i)LIMIT"),
    LineRule("sc_js_tests", "empty_suite", r"""describe\s*\(\s*["'].*["']\s*,\s*\(\)\s*=>\s*\{\s*\}\s*\)""", paths=_JS),
)
#: Rules whose first matching subtype alone counts on a line.
FIRST_ONLY = ("sc_hardcoded", "sc_deprecated", "sc_critical_code")
NEAR_RULES = (
    NearRule("sc_thread_safety", "", "[Tt]hread", -5, 4, r"self\.|\.append|\.update"),
    NearRule("sc_unhandled", "json_parse", r"json\.loads?\([^)]+\)(?!\s*(?:except|try))", -2, 0, "", "try:"),
    NearRule("sc_unhandled", "network_call", r"requests\.\w+\([^)]+\)(?!\s*(?:except|try))", -2, 0, "", "try:"),
    NearRule("sc_unhandled", "int_conversion", r"int\([^)]+\)(?!\s*(?:except|try))", -2, 0, "", "try:"),
    NearRule("sc_bounds", "literal", r"\[\d+\]", -1, 0, "", r"len\(|if "),
    NearRule("sc_bounds", "negative", r"\[-\d+\]", -1, 0, "", r"len\(|if "),
    NearRule("sc_retry", "no_backoff", "(?i:retry)|for.*range|range.*for", 0, 5, "(?i)retry", "(?i)sleep|backoff|delay|wait"),
    NearRule("sc_silent", "no_log", r"^\s*except.*:", 1, 3, r"\S", "log|print|raise|pass"),
    NearRule("sc_thread_leak", "no_join", r"Thread\(", 1, 5, "", r"\.join\(\)", also=r"\.start\(\)"),
    NearRule("sc_nplus1_window", "", "for ", 1, 5, r"\.query|\.filter|\.get\(|SELECT|select", also=" in "),
    NearRule("sc_unbounded_query", "all", r"\.all\(\)", -4, 0, "", r"\.limit\(|LIMIT"),
    NearRule("sc_js_tests", "no_assertion", r"\b(it|test)\s*\(", 1, 20, "", r"expect\(|assert|should", paths=_JS),
    NearRule("sc_js_docs", "function", r"\b(function|const|let|var)\s+[a-zA-Z0-9]\w*\s*=\s*(async\s+)?(\(.*?\)|function)", -1, -1, "", r"^\s*(/\*\*|\*)", paths=_JS),
    NearRule("sc_js_docs", "class", r"\bclass\s+[a-zA-Z0-9]\w*", -1, -1, "", r"^\s*/\*\*", paths=_JS, skip=_JS_FUNCTION),
)
FILE_RULES = (
    FileRule("sc_insecure", "sql_concat", r"""(?i)query\s*[+=]\s*["'].*'\s*\+""", paths=r"\.(py|js|ts|sql|yml|yaml)$"),
    FileRule("sc_insecure", "disabled_auth", r"(?i)auth\s*[=:]\s*(False|false|None)", paths=r"\.(py|js|ts|sql|yml|yaml)$"),
    FileRule("sc_insecure", "permissive_cors", r"""(?i)CORS.*\*|allow_origin\s*[=:]\s*["']\*["']""", paths=r"\.(py|js|ts|sql|yml|yaml)$"),
    FileRule("sc_insecure", "debug_mode", r"(?i)DEBUG\s*[=:]\s*(True|true)", paths=r"\.(py|js|ts|sql|yml|yaml)$"),
    FileRule("sc_await_loop", "", r"(?s)for\s+\w+\s+in\s+.*?:.*?await", every=True),
    FileRule("sc_async_blocking_file", "", "async def", (r"requests\.get|time\.sleep",)),
    FileRule("sc_nplus1_file", "", r"(?s)for\s+\w+\s+in\s+.*?:.*?\.query\(|\.get\(|\.filter\(", every=True),
    *(FileRule("sc_io_file", n, p, ("def ", "(?i)request")) for n, p in (("open", r"open\("), ("read", r"read\("), ("write", r"write\("))),
    *(FileRule("sc_io_file", n, p) for n, p in (("requests", r"requests\.get"), ("urlopen", "urlopen"), ("socket", r"socket\."))),
    FileRule("sc_cache_growth", "", r"self\.cache\s*=\s*\{\}|cache\s*=\s*\[\]", skip=r"del |clear\("),
    FileRule("sc_algorithms", "nested_for", r"for\s+\w+\s+in\s+.*?:\s*for\s+\w+\s+in"),
    FileRule("sc_algorithms", "list_membership", r" in list|\.append", (" in ",)),
    *(FileRule("sc_readme", w, "^", skip=rf"(?i)##\s*{w}", paths="README") for w in ("Installation", "Usage", "Features", "Contributing")),
)
# Modules that are not third-party ones.
STDLIB = (
    "os", "sys", "re", "json", "time", "datetime", "collections",
    "itertools", "functools", "operator", "math", "random", "statistics",
    "decimal", "fractions", "cmath", "string", "io", "pathlib", "glob",
    "fnmatch", "shutil", "sqlite3", "zlib", "gzip", "bz2", "lzma",
    "pickle", "configparser", "logging", "argparse", "getpass", "curses",
    "platform", "subprocess", "socket", "ssl", "select", "selectors",
    "asyncio", "threading", "multiprocessing", "concurrent", "urllib",
    "http", "ftplib", "poplib", "imaplib", "smtplib", "uuid", "socketserver",
    "xmlrpc", "csv", "netrc", "plistlib",
)
# The levels of folders.
LAYERS = {"api": 0, "routers": 0, "views": 0, "controllers": 0, "handlers": 0, "services": 1, "business": 1, "logic": 1, "core": 1,
          "repositories": 2, "models": 2, "db": 2, "database": 2, "data": 2, "storage": 2}
# Names of test files for a source file's stem.
TEST_NAMES = ("test_{}.py", "{}_test.py", "{}.test.js", "{}.test.ts", "{}.spec.js", "{}.spec.ts")
# Patterns of locks, risky calls in constructors, and branch words.
DEADLOCK, LOCK_USE = r"\.acquire\(|with.*lock", r"(lock|Lock|mutex)\.acquire|with\s+\w+:"
RISKY_INIT = r"open\(|\.parse|\.get|json\.load|requests\."
BRANCHES = r"\b(if|elif|else|for|while)\b"
