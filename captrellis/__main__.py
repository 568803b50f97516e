"""``python -m captrellis job.yaml [section.key=value ...]``: run one job and print its report as a line of JSON.

The file, YAML or JSON, holds

* ``job``: ``prepare_urls``, ``prepare_narratives``, ``build_batches`` or ``evaluate``;
* ``conf``: what the job's function in :mod:`captrellis.plans.jobs` reads;
* ``run``: name of the run, by default the file's name; tables staged by it are dropped when it ends;
* ``spark``: ``app``, ``master`` and ``settings``, all optional; ``spark-submit`` may give them instead;
* ``fetcher`` (for ``prepare_urls``): ``call``, a ``module:function`` that makes a fetcher, and its ``args``; the HTTP fetcher by default;
* ``predictor`` (for ``evaluate``): ``call``, a ``module:function`` that makes a predictor inside a task, and its ``args``.

Arguments replace single values of the file; they are read as YAML or JSON too.
"""

from __future__ import annotations

import functools
import importlib
import json
import re
import sys
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from captrellis.plans import jobs
from captrellis.session import build_session, owned_run

JOBS = ("prepare_urls", "prepare_narratives", "build_batches", "evaluate")
HTTP_FETCHER = "captrellis.sources.fetch:http_fetcher"


def parse(text: str) -> Any:
    """A YAML document, or a JSON one where no YAML reader is installed."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def load(path: str, changes: list[str]) -> dict[str, Any]:
    """The job file with ``changes`` (``section.key=value``) applied, checked as far as it can be without Spark."""
    job = parse(Path(path).read_text())
    if not isinstance(job, dict):
        raise ValueError(f"{path} holds no mapping")
    for change in changes:
        name, sign, value = change.partition("=")
        if not sign:
            raise ValueError(f"{change!r} is not of the form section.key=value")
        *sections, last = name.split(".")
        at = job
        for section in sections:
            at = at.setdefault(section, {})
            if not isinstance(at, dict):
                raise ValueError(f"{section!r} in {name!r} is no section")
        at[last] = parse(value)
    if job.get("job") not in JOBS:
        raise ValueError(f"job is {job.get('job')!r}; use one of {', '.join(JOBS)}")
    if not isinstance(job.get("conf"), dict):
        raise ValueError("the section conf is missing")
    if job["job"] == "evaluate" and not job.get("predictor"):
        raise ValueError("evaluate needs the section predictor")
    job.setdefault("run", re.sub(r"[^\w-]", "-", Path(path).stem, flags=re.ASCII))
    return job


def made(section: dict[str, Any]) -> Callable:
    """``call`` of a section, a ``module:function``, with its ``args`` bound."""
    module, _, name = section["call"].partition(":")
    return functools.partial(getattr(importlib.import_module(module), name), **section.get("args") or {})


def run(spark: SparkSession, job: dict[str, Any]) -> dict[str, Any]:
    """Run a loaded job; its staged tables are gone afterwards, outputs stay."""
    with owned_run(spark, job["run"]):
        if job["job"] == "prepare_urls":
            return jobs.prepare_urls(spark, job["conf"], made(job.get("fetcher") or {"call": HTTP_FETCHER})())
        if job["job"] == "prepare_narratives":
            return jobs.prepare_narratives(spark, job["conf"])
        if job["job"] == "build_batches":
            return {r["split"]: r["count"] for r in jobs.build_batches(spark, job["conf"]).groupBy("split").count().collect()}
        return {"cider": jobs.evaluate(spark, job["conf"], made(job["predictor"]))}


def main(argv: list[str]) -> int:
    if not argv:
        print(__doc__, file=sys.stderr)
        return 2
    try:
        job = load(argv[0], argv[1:])
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    wanted = job.get("spark") or {}
    spark = build_session(wanted.get("app", job["run"]), wanted.get("master"), **wanted.get("settings") or {})
    print(json.dumps({"job": job["job"], "run": job["run"], "report": run(spark, job)}), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
