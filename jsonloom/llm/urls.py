"""URL filter: path rules first, else a logistic regression on hashed character n-grams of host and path.

The model is fitted on the driver from a small labelled table of URLs (labelled_urls.tsv, or any list of the same form; more than
TRAIN_LIMIT rows are refused). Rules are (host, path prefix, verdict): a rule fits its host and all subdomains where the
URL's path starts with the rule's; the rule with the longest host and path wins. Rules are tried in SQL, the model scores in
Arrow batches, and nothing is shuffled.

Defined results: host and path are empty for a null URL or one without "://"; such a URL gets the model's verdict on
nothing, which is the sign of its intercept. Repeated rows are judged alike; a null page_id stays null; an empty table gives no
rows; only the id and the URL are read, so other columns' names can't clash; a very long URL takes time and memory in
proportion to its length.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (3, 4)
BUCKETS = 1 << 14
TRAIN_LIMIT = 5_000
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def labelled_urls(path: str | None = None) -> list[tuple[str, int]]:
    """A small labelled table, url and block (1: to be blocked), tab-separated with a head line; the one beside this module (URLs
    written down by hand, of kinds that such filters are known for, and of well-known or everyday sites) if no path is given."""
    rows = (Path(path) if path else Path(__file__).with_name("labelled_urls.tsv")).read_text("utf-8").splitlines()[1:]
    return [(url, int(block)) for url, block in (r.split("\t") for r in rows)]


def under_languages(labelled: list[tuple[str, int]], languages: tuple[str, ...] = ("en", "de", "fr", "es")) -> list[tuple[str, int]]:
    """labelled, and each of its hosts under a path of each language: such paths are as common for both kinds of host, and a small
    table has too few of them to show it."""
    hosts = [("/".join(url.split("/")[:3]), y) for url, y in labelled]
    return labelled + [(f"{host}/{x}/{i}", y) for i, (host, y) in enumerate(hosts) for x in languages]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or the end."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule that wins and its verdict, null where none fits; of two rules as long, the first in order of host and path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for at, prefix, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(prefix)
        name, verdict = F.when(fits, F.lit(at + prefix)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def names_of(host: str) -> str:
    """A host without www and its last label, which say little about what it is, if anything is left."""
    labels = [x for x in host.split(".") if x != "www"]
    return ".".join(labels[:-1] or labels)


def features(host: str, path: str) -> np.ndarray:
    """Buckets of the character n-grams of a host and of a path, apart from each other; all digits are one, each counts once."""
    found = set()
    host, path = (x.translate({c: "0" for c in range(49, 58)}) for x in (names_of(host), path))
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for size in SIZES:
            found.update(xxhash.xxh3_64_intdigest(f"{kind}{text[i : i + size]}") % BUCKETS for i in range(len(text) - size + 1) if host)
    return np.array(sorted(found), np.int64)


def split_url(url: str) -> tuple[str, str]:
    """host_and_path() of one URL of the labelled table."""
    rest = url.partition("://")[2]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    return rest[:cut].translate({c: c + 32 for c in range(65, 91)}), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def margin(x: np.ndarray, weights: np.ndarray) -> float:
    """The score before the logistic function: the n-grams that the table knows count, the others say nothing."""
    known = weights[x]
    known = known[known != 0]
    return float(known.sum() / np.sqrt(max(len(known), 1)) + weights[-1])


def fit(labelled: list[tuple[str, int]], rounds: int = 1500, rate: float = 4.0, decay: float = 1e-4) -> np.ndarray:
    """Weights by bucket, then the intercept: gradient descent on the mean log loss, both classes weighing alike, with an L2
    penalty."""
    if len(labelled) > TRAIN_LIMIT:
        raise ValueError(f"more than {TRAIN_LIMIT} labelled URLs")
    found = [features(*split_url(url)) for url, _ in labelled]
    used = np.unique(np.concatenate([np.empty(0, np.int64), *found]))
    rows = np.zeros((len(found), len(used) + 1))
    for row, x in zip(rows, found, strict=True):
        row[np.searchsorted(used, x)] = 1 / np.sqrt(max(len(x), 1))
    truth = np.array([y for _, y in labelled], float)
    share = np.where(truth > 0, 0.5 / max(truth.sum(), 1), 0.5 / max((1 - truth).sum(), 1))
    # the weights are a sum of rows, so the steps can be taken on the rows' shares in it, which are fewer than the n-grams
    rows = rows[:, :-1]
    alike, shares, intercept = rows @ rows.T, np.zeros(len(rows)), 0.0
    for _ in range(rounds):
        slope = share * (1 / (1 + np.exp(-(alike @ shares + intercept))) - truth)
        shares = shares * (1 - rate * decay) - rate * slope
        intercept -= rate * slope.sum()
    w = np.r_[rows.T @ shares, intercept]
    out = np.zeros(BUCKETS + 1)
    out[used], out[-1] = w[:-1], w[-1]
    return out


def judged(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, labelled: list[tuple[str, int]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score (how likely it is to be blocked) of each row."""
    weights = fit(under_languages(labelled_urls()) if labelled is None else labelled)

    def score(batches):
        for batch in batches:
            scores = []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                scores.append(float(1 / (1 + np.exp(-margin(features(host, path), weights)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    host, path = host_and_path(F.col(f"`{url}`"))
    parts = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = parts.mapInArrow(score, f"page_id {parts.schema['page_id'].dataType.simpleString()}, host string, path string, score double")
    return scored.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")
