"""Stateful tracking: identities carried from frame to frame, in batch or as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tesserae.operators.evaluation import iou_matrix
from tesserae.operators.matching import BOX, assignment
from tesserae.session import ready

TRACK = "video {v}, frame long, det long, track long, period long, lost long"


@dataclass(frozen=True)
class TrackOptions:
    """method: greedy (pairs over the threshold in the order of old, then new) or hungarian (IoU as gain; every pair that is assigned
    counts as a match if forced, else only those over the threshold). A track lives `patience` frames unseen if it was seen for
    `min_period` frames and its box is at least `min_size` of the frame in both directions."""

    method: str = "greedy"
    threshold: float = 0.5
    patience: int = 1
    min_period: int = 0
    min_size: float = 0.0
    frame: tuple[int, int] = (1 << 30, 1 << 30)
    forced: bool = False
    max_tracks: int = 200

    def __post_init__(self):
        if self.method not in ("greedy", "hungarian"):
            raise ValueError("method must be greedy or hungarian")


def step(state: list[dict], boxes: np.ndarray, next_id: int, o: TrackOptions) -> tuple[list[dict], list[dict], int]:
    """The tracks of the new boxes, those kept unseen, and the next free identity. state: id, period, lost, box."""
    old = np.array([s["box"] for s in state], float).reshape(-1, 4)
    ious = iou_matrix(old, boxes)
    match: dict[int, int] = {}
    if o.method == "greedy":
        taken: set[int] = set()
        for i, j in zip(*np.nonzero(ious >= o.threshold), strict=True):
            if int(i) not in taken and int(j) not in match:
                match[int(j)] = int(i)
                taken.add(int(i))
    elif len(state) and len(boxes):
        cost = np.where(ious > o.threshold, -1.0, 100_000.0)
        for i, j in zip(*assignment(cost), strict=True):
            if o.forced or ious[i, j] > o.threshold:
                match[int(j)] = int(i)
    now = []
    for j in range(len(boxes)):
        s = state[match[j]] if j in match else None
        if s is None:
            now.append({"id": next_id, "period": 1, "lost": 0, "box": boxes[j].tolist()})
            next_id += 1
        else:
            now.append({"id": s["id"], "period": s["period"] + 1, "lost": 0, "box": boxes[j].tolist()})
    used = set(match.values())
    kept = []
    for i, s in enumerate(state):
        w, h = s["box"][2] - s["box"][0], s["box"][3] - s["box"][1]
        if i not in used and s["lost"] + 1 <= o.patience and s["period"] > o.min_period and w >= o.min_size * min(o.frame[0], 1 << 29) * (o.min_size > 0) and h >= o.min_size * min(o.frame[1], 1 << 29) * (o.min_size > 0) and len(now) + len(kept) < o.max_tracks:
            kept.append({**s, "lost": s["lost"] + 1})
    return now, kept, next_id


def _frames(pdf: pd.DataFrame, state: list[dict], next_id: int, o: TrackOptions) -> tuple[list[tuple], list[dict], int]:
    out = []
    for frame, own in pdf.sort_values(["frame", "det"]).groupby("frame", sort=True):
        now, kept, next_id = step(state, own[BOX].to_numpy(float), next_id, o)
        out += [(int(frame), int(d), t["id"], t["period"], t["lost"]) for d, t in zip(own["det"], now, strict=True)]
        state = now + kept
    return out, state, next_id


def track(detections: DataFrame, options: TrackOptions = TrackOptions()) -> DataFrame:  # noqa: B008
    """video, frame, det, track, period, lost of detections (video, frame, det, box). A video's frames pass one task in order, sorted on
    disk if need be; what is held is the last frame's tracks and the rows of one frame."""
    names = ["video", "frame", "det", "track", "period", "lost"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, state, next_id, held = None, [], 0, None
        for b in batches:
            out = []
            # the last frame of a batch may go on in the next one
            rows = b if held is None else pd.concat([held, b])
            whole = (rows["video"] != rows["video"].iloc[-1]) | (rows["frame"] != rows["frame"].iloc[-1])
            held = rows[~whole]
            for key, own in rows[whole].groupby("video", sort=False):
                if key != video:
                    video, state, next_id = key, [], 0
                found, state, next_id = _frames(own, state, next_id, options)
                out += [(key, *x) for x in found]
            yield pd.DataFrame(out, columns=names)
        if held is not None and len(held):
            key = held["video"].iloc[0]
            if key != video:
                state, next_id = [], 0
            found, _, _ = _frames(held, state, next_id, options)
            yield pd.DataFrame([(key, *x) for x in found], columns=names)

    ready(detections.sparkSession)
    slim = detections.select("video", "frame", "det", *BOX).repartition("video").sortWithinPartitions("video", "frame", "det")
    return slim.mapInPandas(run, TRACK.format(v=dict(detections.dtypes)["video"]))


def track_stream(detections: DataFrame, options: TrackOptions = TrackOptions()) -> DataFrame:  # noqa: B008
    """The same over a stream: the state of a video is its last frame's tracks and the next identity."""
    import json

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = ["frame", "det", "track", "period", "lost"]

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracks, next_id = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], 0)
        pdf = pd.concat(list(pdfs))
        out, tracks, next_id = _frames(pdf, tracks, next_id, options)
        state.update((json.dumps(tracks), next_id))
        yield pd.DataFrame(out, columns=names).assign(video=key[0])[["video", *names]]

    ready(detections.sparkSession)
    return detections.groupBy("video").applyInPandasWithState(run, TRACK.format(v=dict(detections.dtypes)["video"]), "tracks string, next_id long", "append", GroupStateTimeout.NoTimeout)
