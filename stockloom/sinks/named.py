"""Files of given names, written by the tasks that hold their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_named_files(files: DataFrame, folder: str) -> int:
    """Write each row of (``name``, ``content``) as a file into a local or shared folder; the number of files.

    Names may hold subfolders. A file is written beside its place and then moved there, so that it is whole or absent
    and a repeated task replaces it. A null content is an empty file; of equal names, any one stays. Rows are dealt out
    first, as a small table of many names would be written by one task.
    """
    target = "/" + folder.removeprefix("file:").lstrip("/")

    # Nested, so that it is sent with the tasks and executors need no copy of the package.
    def write(frames):
        import os
        import uuid

        import pandas as pd

        made, own, n = set(), uuid.uuid4().hex, 0
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"]):
                path = os.path.join(target, name)
                parent = os.path.dirname(path)
                if parent not in made:
                    os.makedirs(parent, exist_ok=True)
                    made.add(parent)
                part, n = os.path.join(parent, f".{own}-{n}"), n + 1
                with open(part, "wb") as handle:
                    handle.write(content or b"")
                os.replace(part, path)
            yield pd.DataFrame({"n": [len(frame)]})

    dealt = files.select("name", "content").repartition(files.sparkSession.sparkContext.defaultParallelism, "name")
    return dealt.mapInPandas(write, "n bigint").groupBy().sum("n").head()[0] or 0
