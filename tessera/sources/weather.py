"""Node-by-step weather arrays: little-endian 32-bit floats with a JSON header, as long rows."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The column of each variable and the name its files have.
FILES = {"airtemp": "air_temperature_daily", "humidity": "relative_humidity_daily", "rainfall": "rainfall_daily", "landtemp": "land_temperature_daily"}
VARIABLES = tuple(FILES)


def offsets_text(nodes: list[int], steps: int) -> str:
    """Eight hexadecimal digits of each node, and eight of where its values start."""
    return "".join(f"{n:08x}{i * steps * 4:08x}" for i, n in enumerate(nodes))


def parse_offsets(text: str) -> list[tuple[int, int]]:
    return [(int(text[i : i + 8], 16), int(text[i + 8 : i + 16], 16)) for i in range(0, len(text), 16)]


def write_weather(df: DataFrame, folder: str, prefix: str, profile: str = "seasonal") -> None:
    """One binary file and one header per variable, nodes and steps ascending. Each node needs the same steps.

    Nodes are packed by tasks; only the order of nodes and the number of steps come to the driver.
    """
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    size = df.groupBy("node_id").agg(F.count("*").alias("n")).orderBy("node_id").collect()
    steps = {r.n for r in size}
    if len(steps) > 1:
        raise ValueError("nodes differ in their number of steps")
    nodes, n = [r.node_id for r in size], next(iter(steps), 0)
    for v in VARIABLES:
        packed = df.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("steps", v))), lambda x: x[v]).alias("values")).orderBy("node_id")
        with system.open_output_stream(f"{path}/{prefix}_{FILES[v]}.bin", compression=None) as out:
            for row in packed.toLocalIterator():
                out.write(np.array(row["values"], "<f4").tobytes())
        head = {"Metadata": {"DatavalueCount": n, "NodeCount": len(nodes), "UpdateResolution": "CLIMATE_UPDATE_DAY", "IdReference": "Legacy", "ClimateProfile": profile}, "NodeOffsets": offsets_text(nodes, n)}
        with system.open_output_stream(f"{path}/{prefix}_{FILES[v]}.bin.json", compression=None) as out:
            out.write(json.dumps(head, indent=2).encode())


def read_weather(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """(node_id, steps, one column per variable): a task per node reads its own part of each file."""
    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{path}/{prefix}_{FILES[VARIABLES[0]]}.bin.json") as f:
        head = json.loads(f.read())
    n = head["Metadata"]["DatavalueCount"]
    nodes = spark.createDataFrame(parse_offsets(head["NodeOffsets"]), "node_id long, start long")

    def run(batches):
        system, path = fs.FileSystem.from_uri(folder)
        files = [system.open_input_file(f"{path}/{prefix}_{FILES[v]}.bin") for v in VARIABLES]
        for batch in batches:
            for node, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = [np.frombuffer(f.read_at(4 * n, start), "<f4") for f in files]
                yield pa.record_batch([pa.array([node] * n, pa.int64()), pa.array(np.arange(1, n + 1), pa.int32()), *(pa.array(x) for x in values)], ["node_id", "steps", *VARIABLES])

    return nodes.mapInArrow(run, "node_id long, steps int, " + ", ".join(f"{v} float" for v in VARIABLES))
