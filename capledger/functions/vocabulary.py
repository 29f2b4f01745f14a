"""Closed word lists that results depend on. Changing one changes results: locks, samples and reports made with another don't compare."""

from __future__ import annotations

#: Language of a file by its extension as written; files without one are known by name.
LANGUAGES = {
    **dict.fromkeys(("yml", "yaml"), "yaml"), **dict.fromkeys(("zsh", "bash", "sh"), "shell"), **dict.fromkeys(("cts", "mts", "ts"), "typescript"), **dict.fromkeys(("text", "txt"), "text"),
    **dict.fromkeys(("tsx", "jsx", "cjs", "mjs", "js"), "javascript"), **dict.fromkeys(("pyi", "py"), "python"), **dict.fromkeys(("markdown", "md"), "markdown"),
    "toml": "toml", "json": "json", "go": "go", "rs": "rust", "rb": "ruby",
}
NAMES = {"Makefile": "make", "Dockerfile": "dockerfile"}
#: Languages that are read for capabilities, and all that run.
CODE = ("javascript", "python", "shell", "typescript")
EXECUTABLE = (*CODE, "go", "ruby", "rust")
#: What a link that leaves a bundle has to end in to count as code out of reach.
CODE_EXTENSIONS = tuple(sorted("ts py sh js mjs mts cjs cts jsx pyi zsh bash".split(), key=lambda e: (len(e), e)))

#: Words too common to tell one description from another, by length.
STOPWORDS = tuple(
    "its has how any are but can for que use you and was the not "
    "they then that them uses used this have from with were when will into what your "
    "using which their these those should".split()
)

#: Needles of each lexical marker, in the order of reports.
MARKERS = {
    "credential_paths": (".env", ".netrc", "keychain", "~/.ssh", "~/.aws", "~/.kube", ".ssh/id_", "~/.config/gh", ".aws/credentials", ".docker/config.json"),
    "secret_env": ("_KEY", "_TOKEN", "_SECRET", "_PASSWORD", "OPENAI_API", "GITHUB_TOKEN", "ANTHROPIC_API"),
    "network": ("httpx", "axios", "curl ", "wget ", "urllib", "fetch(", "http://", "https://", "requests.get", "requests.post"),
    "agent_config_write": (".mcp.json", "CLAUDE.md", "statusline", "settings.json", ".claude/hooks"),
    "dynamic_eval": ("eval(", "exec(", "sh -c", "bash -c", "source ", "os.system", "Function(", "subprocess", "child_process"),
    "install_fetch": ("iwr ", "curl | sh", "install.sh", "curl -fsSL", "curl | bash", "postinstall"),
    "encoding_chain": ("atob(", "base64", "b64decode", "fromCharCode", "codecs.decode"),
}
#: Markers that make a bundle with code, and without credential paths, one of ``code_other_marker``.
OTHER_MARKERS = ("secret_env", "dynamic_eval", "agent_config_write", "install_fetch", "encoding_chain")
QUOTAS = {"prose_only": 15, "code_other_marker": 15, "disclosure_shape": 20, "code_credential": 40, "code_clean": 40}

#: Classes of why something was passed over: the words that tell it, first match first. Reasons themselves name paths and people.
SKIPS = (
    (("virus", "unwanted software"), "blocked by the host's antivirus while archiving"),
    (("could not be archived",), "could not be written to the archive"),
    (("fetch failed",), "could not be cloned"),
    (("no skill.md",), "repository contained no SKILL.md"),
    (("could not be parsed",), "bundle could not be parsed"),
    (("could not be measured",), "archived bundle could not be re-measured"),
)

#: Frontmatter keys that every bundle has, and those that say its version.
CORE_KEYS = ("description", "name")
VERSION_KEYS = ("revision", "schema_version", "version")

#: Words that would be a verdict; some only as JSON strings.
VERDICTS = ('"safe"', '"grade"', "unsafe", "severity", "dangerous", "malicious", "risk_score", "suspicious", "threat_level")

#: Kinds of what a model may find.
KINDS = ("undeclared_instruction", "obfuscated_intent", "injection_attempt", "disclosure_delta")
#: Wording that speaks to whoever audits, by length.
PHRASES = (
    "omit the", "do not flag", "you are now", "do not report", "system prompt", "as the operator", "developer mode",
    "do not mention", "already audited", "ignore previous", "return an empty", "already reviewed", "ignore the above", "maintenance mode", "new instructions",
    "skip the analysis", "disregard previous", "disregard the above", "output no findings", "report no findings", "forget all previous", "ignore all previous",
    "disregard all previous", "this skill is approved", "forget your instructions", "override your instructions", "report this skill as clean",
    "no capabilities were found", "this skill has been reviewed", "on behalf of capledger",
)
