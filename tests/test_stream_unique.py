"""Unique messages as state of a stream: files in any order give the rows of one pass over all of them."""

import random

from strandline.operators import unique
from strandline.sources import files
from strandline.streaming import ingest


def export(rows):
    return "\n".join(f"From: {who}\nSent: {at}\nSubject: {body}\n\n{body}\n" for who, at, body in rows)


def test_files_in_any_order(spark, tmp_path):
    r = random.Random(6)
    texts = {f"f{k}.txt": export([(r.choice(["Ann <a@x>", "bob"]), r.choice(["2025-01-01 10:00", f"2025-01-0{r.randint(1, 9)} 9:30", "soon"]), f"body {r.randint(0, 6)}") for _ in range(r.randint(1, 5))]) for k in range(6)}
    whole = tmp_path / "in"
    whole.mkdir()
    names = list(texts)
    r.shuffle(names)
    for some in (names[:2], names[2:3], names[3:]):  # three arrivals, the last in several batches
        for name in some:
            (whole / name).write_text(texts[name])
        ingest.stream_unique(spark, str(whole), str(tmp_path / "out"), str(tmp_path / "state"), files_per_batch=2).awaitTermination()
    order = sorted(texts)
    found = files.read_directory(spark, str(whole))
    expected = {(r.sender, r.body, r.timestamp, r.subject, order[r.first_seen.file_id], r.first_seen.msg_idx, r.msg_idx, r.name, r.occurrences) for r in unique.unique_messages(found.messages).collect()}
    base = lambda path: path.rsplit("/", 1)[1]
    got = [(r.sender, r.body, r.timestamp, r.subject, base(r.first_seen.path), r.first_seen.msg_idx, r.msg_idx, base(r.path), r.occurrences) for r in ingest.unique_so_far(spark, str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
