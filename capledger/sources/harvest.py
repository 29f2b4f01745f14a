"""Repositories to bundle files: fetched on executors, bundles found in them, failures told. The way of fetching is a plain callable; one for folders and one for ``git`` are here, any other, a network's among them, can be given."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capledger.operators import corpus
from capledger.sources import archive
from capledger.sources.tables import walk

#: Repositories taken from one source.
LIMIT = 200
Fetch = Callable[[str, str, str, str], None]
_FILE = pa.schema([("repo", pa.string()), ("commit", pa.string()), ("bundle_root", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("reason", pa.string()), ("note", pa.string())])


def local_fetcher(folder: str) -> Fetch:
    """Repositories as folders ``owner/name`` below a mounted one, whatever the commit."""

    def fetch(owner: str, name: str, commit: str, into: str) -> None:
        shutil.copytree(os.path.join(folder, owner, name), into, symlinks=True, dirs_exist_ok=True)

    return fetch


def git_fetcher(base: str, seconds: int = 300) -> Fetch:
    """The one commit, without history, of ``base/owner/name``, by the ``git`` program; nothing is asked for at a terminal, no hook is run."""

    def fetch(owner: str, name: str, commit: str, into: str) -> None:
        env = os.environ | {"GIT_TERMINAL_PROMPT": "0", "GIT_CONFIG_NOSYSTEM": "1"}

        def git(*a: str) -> None:
            subprocess.run(["git", "-c", "core.hooksPath=/dev/null", "-C", into, *a], check=True, capture_output=True, timeout=seconds, env=env)

        os.makedirs(into, exist_ok=True)
        git("init", "-q")
        git("fetch", "-q", "--depth", "1", f"{base.rstrip('/')}/{owner}/{name}", commit)
        git("checkout", "-q", "FETCH_HEAD")

    return fetch


def bundle_roots(folder: str) -> list[str]:
    """Directories that hold exactly ``SKILL.md`` and lie in no other such, in order; links aren't followed and ``.git`` is passed over."""
    found = []
    for at, folders, files in os.walk(folder):
        folders[:] = sorted(f for f in folders if f != ".git")
        if "SKILL.md" in files:
            found.append(os.path.relpath(at, folder).replace(os.sep, "/"))
            folders.clear()
    return sorted(found)


def fetched(repos: DataFrame, fetch: Fetch) -> DataFrame:
    """``(repo, commit, bundle_root, path, content, reason, note)``: all files of all bundles of the repositories, one repository after the other in a task's own temporary folder, which is gone afterwards.

    repos: owner, name, commit. A repository that can't be fetched, or has no bundle, is one row with a note and no bundle; it ends nothing. ``.`` is a bundle at the repository's root.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FILE)], schema=_FILE)

        for b in it:
            for owner, name, commit in zip(*(c.to_pylist() for c in b.columns)):
                repo = f"{owner}/{name}"
                with tempfile.TemporaryDirectory(prefix="capledger-fetch-") as into:
                    try:
                        fetch(owner, name, commit, into)
                    except (OSError, shutil.Error, subprocess.SubprocessError) as e:
                        yield batch([(repo, commit, None, None, None, "skipped", f"fetch failed: {type(e).__name__}")])
                        continue
                    roots = bundle_roots(into)
                    if not roots:
                        yield batch([(repo, commit, None, None, None, "skipped", "no SKILL.md in the repository")])
                    for root in roots:
                        for path, content, reason, note in walk(os.path.join(into, root)):
                            if path != ".git" and not path.startswith(".git/"):
                                yield batch([(repo, commit, root, path, content, reason, note)])

    return repos.select("owner", "name", "commit").mapInArrow(run, "repo string, commit string, bundle_root string, path string, content binary, reason string, note string")


def wanted(repos: DataFrame, ledger: DataFrame | None, limit: int = LIMIT) -> DataFrame:
    """The first ``limit`` repositories of each source by owner and name, of which those go that the ledger has at this commit. repos: source, owner, name, commit."""
    from pyspark.sql import Window

    first = repos.dropDuplicates(["source", "owner", "name"]).withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("owner", "name"))).where(F.col("n") <= limit).drop("n")
    return first if ledger is None else archive.unfetched(first, ledger)


def contents(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files for a scan: root, path, content; problems for a scan; what was skipped: repo, note, class) of what was fetched. A bundle's root is ``owner/name/root``."""
    root = F.concat_ws("/", "repo", "bundle_root").alias("root")
    files = rows.where("content is not null").select(root, "path", "content")
    problems = rows.where("bundle_root is not null and reason is not null").select(root, "reason", F.col("path").alias("file"), "note")
    skipped = rows.where("reason = 'skipped'").select("repo", "note", corpus.T.skip_class(F.col("note")).alias("class"))
    return files, problems, skipped
