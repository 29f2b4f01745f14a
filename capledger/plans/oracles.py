"""The closed lists once more, typed by hand for the SQL side, so that a query and its SQL don't agree only because both read one list."""

from __future__ import annotations


def listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


#: From the end of the alphabet.
STOP = """your you with will which when were was
what using uses used use those this they these then them their the that should que
not its into how have has from for can but are any and""".split()

NEEDLES = {
    "encoding_chain": ["codecs.decode", "fromCharCode", "atob(", "b64decode", "base64"],
    "install_fetch": ["install.sh", "iwr ", "curl | bash", "curl | sh", "curl -fsSL", "postinstall"],
    "dynamic_eval": ["bash -c", "sh -c", "source ", "Function(", "child_process", "subprocess", "os.system", "exec(", "eval("],
    "agent_config_write": [".mcp.json", "statusline", ".claude/hooks", "settings.json", "CLAUDE.md"],
    "network": ["wget ", "curl ", "fetch(", "axios", "httpx", "urllib", "requests.post", "requests.get", "https://", "http://"],
    "secret_env": ["ANTHROPIC_API", "OPENAI_API", "GITHUB_TOKEN", "_PASSWORD", "_SECRET", "_KEY", "_TOKEN"],
    "credential_paths": [".env", "keychain", ".docker/config.json", ".netrc", "~/.kube", "~/.config/gh", ".ssh/id_", "~/.ssh", ".aws/credentials", "~/.aws"],
}
#: Texts that a needle is in, and some that only begin like one.
SHOWN = [n for ns in NEEDLES.values() for n in ns] + [".envelope", "b64decoder", "API_KEYS", "httpx2", "settings.jsonl", "~/.ssh2", "keychains", "a source", "evaluate(", "exec (", "_TOKENS", "my_TOKEN.", "base64,", "axios!"]

EXTENSIONS = {
    "markdown": ["md", "markdown"], "python": ["py", "pyi"], "javascript": ["js", "jsx", "mjs", "cjs", "tsx"], "typescript": ["ts", "mts", "cts"], "shell": ["sh", "zsh", "bash"],
    "ruby": ["rb"], "rust": ["rs"], "go": ["go"], "json": ["json"], "toml": ["toml"], "yaml": ["yaml", "yml"], "text": ["text", "txt"], "unknown": ["html", "css", "PY", "c", "exe", "Md"],
}
OUTSIDE = ["bash", "cjs", "cts", "js", "jsx", "mjs", "mts", "py", "pyi", "sh", "ts", "zsh"]

REASONS = [
    ("Fetch failed: no such host", "could not be cloned"), ("Operation did not complete: VIRUS found", "blocked by the host's antivirus while archiving"), ("found no SKILL.md below /srv", "repository contained no SKILL.md"),
    ("a/b could not be parsed", "bundle could not be parsed"), ("x could not be measured", "archived bundle could not be re-measured"), ("x could not be archived: disk full", "could not be written to the archive"), ("rate limited", "other"), ("potentially unwanted software", "blocked by the host's antivirus while archiving"), ("", "other"),
]

VERDICTS = ["threat_level", "suspicious", "severity", "risk_score", "malicious", "dangerous", "unsafe", '"grade"', '"safe"']
#: (JSON text, whether it is free of verdicts and fractions)
DOCUMENTS = [
    ('{"a": "version 1.5", "b": 3}', True), ('{"a": 1.5}', False), ('{"a": [2, 1e3]}', False), ('{"a": "it is Malicious"}', False), ('{"a": "safe"}', False), ('{"a": "a safe place"}', True), ('{"grade": 1}', False),
    ('{"a": "a \\" 2.5 \\" b", "c": -7}', True), ('{"risk_score": 1}', False), ('{"a": "benign, harmless"}', True), ('{"severity": null}', False), ('{"a": {"b": [0.0]}}', False),
]

PHRASES = """on behalf of capledger|as the operator|no capabilities were found|skip the analysis|omit the|do not mention|do not flag|do not report|return an empty|output no findings
report no findings|report this skill as clean|already reviewed|already audited|this skill has been reviewed|this skill is approved|developer mode|maintenance mode|you are now|system prompt|new instructions
override your instructions|forget all previous|forget your instructions|disregard the above|disregard previous|disregard all previous|ignore the above|ignore previous|ignore all previous""".replace("\n", "|").split("|")
KINDS = ["obfuscated_intent", "injection_attempt", "undeclared_instruction", "disclosure_delta"]
QUOTA = "CASE stratum WHEN 'code_clean' THEN 40 WHEN 'code_credential' THEN 40 WHEN 'disclosure_shape' THEN 20 WHEN 'code_other_marker' THEN 15 WHEN 'prose_only' THEN 15 END"
