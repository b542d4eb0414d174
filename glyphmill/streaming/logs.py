"""Training logs as a stream: state per log, so that lines can come in any number of batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glyphmill.sources.readers import told_lines

EPOCH = "path string, stage string, phase string, epoch int, loss double, runtime int, ts timestamp, printed_cer double, printed_wer double, hw_cer double, hw_wer double, restarted boolean, first_line long, version long"
_RATES = ("printed_cer", "printed_wer", "hw_cer", "hw_wer")


def fold_lines(state: dict, rows: list[dict]) -> list[dict]:
    """Fold a log's next telling lines, in order, into its state; the epochs that changed.

    state: the phase mark that holds, the epoch that evaluations go to, and all epochs so far. An epoch that is run again loses what
    its last run had, but keeps its first line and its last time stamp.
    """
    epochs, changed = state.setdefault("epochs", {}), {}
    for r in rows:
        state["mark"] = r["mark"] or state.get("mark")
        if r["stage"]:
            phase = state["mark"] if r["stage"] == "stage1" else r["stage"][5:]
            name = json.dumps([r["stage"], phase, r["epoch"]])
            old = epochs.get(name)
            new = {"loss": r["loss"], "runtime": r["runtime"], "ts": r["ts"], "restarted": False, "first_line": r["line_no"]} | dict.fromkeys(_RATES)
            if old:
                new |= {"ts": r["ts"] or old["ts"], "restarted": r["stage"] == "stage2a" and bool(old["ts"]), "first_line": old["first_line"]}
            epochs[name], state["at"] = new, name
        if state.get("at"):
            for kind in ("printed", "hw"):
                if r[kind] is not None:
                    epochs[state["at"]] |= {f"{kind}_cer": r[kind][0], f"{kind}_wer": r[kind][1]}
            changed[state["at"]] = epochs[state["at"]] | {"version": r["line_no"]}
    return [dict(zip(("stage", "phase", "epoch"), json.loads(name))) | row for name, row in changed.items()]


def log_epochs(lines: DataFrame) -> DataFrame:
    """The epochs of a stream of log lines (path, line_no, value), each as often as a batch changes it; `version` rises with each change.

    Lines of a log have to come in the order of their numbers over the batches, in any order within one. The state of a log is its
    epochs, not its lines. `latest` leaves the rows that `parse_log` has for the same lines.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(parts)).sort_values("line_no").to_dict("records")
        clean = lambda v: None if v is None or v != v else v
        told = [
            {"mark": r["mark"], "stage": r["stage"], "line_no": int(r["line_no"]), "ts": clean(r["ts"]), "loss": clean(r["loss"])}
            | {c: None if clean(r[c]) is None else int(r[c]) for c in ("epoch", "runtime")}
            | {k: (clean(r[f"{k}_cer"]), clean(r[f"{k}_wer"])) if r[f"has_{k}"] else None for k in ("printed", "hw")}
            for r in rows
        ]
        found = fold_lines(known, told)
        state.update((json.dumps(known),))
        if found:
            out = pd.DataFrame(found).assign(path=key[0])
            out["ts"] = pd.to_datetime(out["ts"])
            for c in ("epoch", "runtime"):
                out[c] = out[c].astype("Int32")
            for c in ("loss", *_RATES):
                out[c] = out[c].astype("Float64")
            yield out[[c.split()[0] for c in EPOCH.split(", ")]]

    told = told_lines(lines)
    flat = told.select(
        "path", "line_no", "mark", "stage", "epoch", "loss", "runtime", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        *[F.col(f"{k}.{r}").alias(f"{k}_{r}") for k in ("printed", "hw") for r in ("cer", "wer")], *[F.col(k).isNotNull().alias(f"has_{k}") for k in ("printed", "hw")],
    )
    return flat.groupBy("path").applyInPandasWithState(run, EPOCH, "known string", "append", GroupStateTimeout.NoTimeout)


def latest(epochs: DataFrame) -> DataFrame:
    """The last version of each epoch."""
    last = epochs.groupBy("path", "stage", "phase", "epoch").agg(F.max_by(F.struct(*[c for c in epochs.columns if c not in ("path", "stage", "phase", "epoch")]), "version").alias("r"))
    return last.select("path", "stage", "phase", "epoch", "r.*").drop("version")
