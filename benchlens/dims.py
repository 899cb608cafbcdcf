"""Dimension tables as plain data.

Each table is a small, fixed literal: its size does not grow with the data,
so joining it with ``broadcast`` is safe at any scale.  Users can pass their
own DataFrame of the same shape to any operator that takes a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values: benchmark registry --------------------------------------
# (file-name prefix, benchmark name, [(metric key, display label, aliases)],
#  parameter keys with aliases).  Order matters: first prefix match wins.
# The aliases are the keys the producers really write.
REGISTRY = [
    ("hpl_", "HPL (Linpack)",
     [("tflops", "TFLOPS", [])],
     [("nodes", [])]),
    ("nccl_", "NCCL AllReduce",
     [("busbw_gb_s", "Bus BW GB/s", []), ("algbw_gb_s", "Algo BW GB/s", [])],
     [("nodes", []), ("msg_size_bytes", [])]),
    ("mlperf_", "MLPerf Storage",
     [("samples_per_sec", "Samples/s", []), ("throughput_mb_s", "Throughput MB/s", [])],
     [("model", []), ("num_accelerators", []), ("batch_size", [])]),
    ("lerobot_", "LeRobot I/O (LIBERO)",
     [("samples_per_sec", "Samples/s", []), ("throughput_mb_s", "Throughput MB/s", []),
      ("avg_latency_ms", "Avg Latency ms", []), ("p99_latency_ms", "p99 Latency ms", [])],
     [("workers", [])]),
    ("pi05_1n", "π₀.₅ Training (1 node × 8 GPU)",
     [("steps_per_sec", "Steps/s", []), ("samples_per_sec", "Samples/s", []),
      ("peak_gpu_mem_gb", "Peak GPU Mem GB", ["peak_mem_gb"]), ("mfu_pct", "MFU %", [])],
     [("world_size", []), ("per_gpu_batch_size", ["batch_size_per_gpu"]),
      ("global_batch_size", []), ("gpu_name", ["gpu"])]),
    ("pi05_2n", "π₀.₅ Training (2 nodes × 8 GPU)",
     [("steps_per_sec", "Steps/s", []), ("samples_per_sec", "Samples/s", []),
      ("peak_gpu_mem_gb", "Peak GPU Mem GB", ["peak_mem_gb"]), ("mfu_pct", "MFU %", [])],
     [("world_size", []), ("per_gpu_batch_size", ["batch_size_per_gpu"]),
      ("global_batch_size", []), ("gpu_name", ["gpu"])]),
    ("pi05_ckpt", "π₀.₅ Checkpoint",
     [("save_gb_s", "Save GB/s", []), ("load_gb_s", "Load GB/s", []),
      ("checkpoint_size_gb", "Checkpoint Size GB", [])],
     [("world_size", [])]),
]
# Extension rows: the sweep job writes storage_sweep_<job>.json, which the
# original registry does not know (its rows were silently dropped).
REGISTRY_EXTENSIONS = [
    ("storage_sweep_", "Storage Sweep",
     [("read_bw_median_mbs", "Read MB/s (median)", []),
      ("write_bw_median_mbs", "Write MB/s (median)", [])],
     [("workers", []), ("passes", [])]),
]

# --- fixed values: peak dense BF16 FLOPS by device name ----------------------
# (order, case-insensitive pattern, FLOPS); first match wins, else default.
PEAK_FLOPS = [
    (1, "H100.*SXM", 989e12),
    (2, "H100.*NVL", 835e12),
    (3, "H100.*PCIe", 756e12),
    (4, "H200.*SXM", 1979e12),
    (5, "B200", 4500e12),
    (6, "B300", 9000e12),
    (7, "A100.*80", 624e12),
    (8, "A100.*40", 312e12),
]
DEFAULT_PEAK_FLOPS = 989e12

# --- fixed values: accelerator Linpack block size by device family ----------
BLOCK_SIZES = [
    (1, "H100|H200|A100", 336),
    (2, "B200|B300|GB200|GB300", 512),
]

# --- fixed values: storage size classes, [lo, hi) bytes ----------------------
KIB, MIB, GIB = 1024, 1024 ** 2, 1024 ** 3
SIZE_CLASSES = [
    (0, 256 * KIB, "metadata / row groups"),
    (256 * KIB, 4 * MIB, "small shards"),
    (4 * MIB, 64 * MIB, "default shards"),
    (64 * MIB, 256 * MIB, "large shards / short video"),
    (256 * MIB, None, "long video / checkpoint fragments"),
]

# --- fixed values: sweep block sizes (label, display label) -----------------
SWEEP_SIZES = [("64k", "64 KB"), ("256k", "256 KB"), ("1m", "1 MB"), ("4m", "4 MB"),
               ("16m", "16 MB"), ("64m", "64 MB"), ("256m", "256 MB"), ("1g", "1 GB")]

# --- fixed values: published results of the measured cluster ----------------
# (metric, value, unit, device peak, other-device peak)
BASELINE = [
    ("hpl_fp64_per_gpu", 1018.0, "GFLOPS", 1300.0, 34000.0),
    ("stream_triad", 7089.0, "GB/s", 8000.0, 3350.0),
    ("allreduce_busbw", 835.0, "GB/s", 1800.0, None),
    ("train_mem_per_gpu", 68.8, "GB", 288.0, None),
]
# Published sequential sweep, workers=1, passes=3: (size label, write MB/s, read MB/s)
BASELINE_SWEEP = [
    ("64k", 13.7, 25.2), ("256k", 54.4, 88.4), ("1m", 215.1, 306.4), ("4m", 798.9, 1082.4),
    ("16m", 1973.8, 2917.8), ("64m", 3728.3, 5263.4), ("256m", 4549.8, 6316.1),
    ("1g", 5187.2, 7064.1),
]


def literal(spark: SparkSession, rows: list, schema) -> DataFrame:
    """A fixed table as a DataFrame."""
    return spark.createDataFrame(rows, schema)


def _size_bytes(label: str) -> int:
    mult = {"k": KIB, "m": MIB, "g": GIB}
    return int(label[:-1]) * mult[label[-1]] if label[-1] in mult else int(label)


def registry_rules(extensions: bool = True) -> list[tuple[int, str, str]]:
    """(reg_ord, prefix, bench) of the registry as literal rows, for lookups in the row."""
    return [(i + 1, p, b) for i, (p, b, _, _) in enumerate(REGISTRY + (REGISTRY_EXTENSIONS if extensions else []))]


def registry(spark: SparkSession, extensions: bool = True) -> DataFrame:
    """The benchmark registry, one row per benchmark (arrays of structs)."""
    rows = REGISTRY + (REGISTRY_EXTENSIONS if extensions else [])
    schema = T.StructType([
        T.StructField("reg_ord", T.IntegerType(), False),
        T.StructField("prefix", T.StringType(), False),
        T.StructField("bench", T.StringType(), False),
        T.StructField("metrics", T.ArrayType(T.StructType([
            T.StructField("key", T.StringType()), T.StructField("label", T.StringType()),
            T.StructField("aliases", T.ArrayType(T.StringType()))]))),
        T.StructField("params", T.ArrayType(T.StructType([
            T.StructField("key", T.StringType()),
            T.StructField("aliases", T.ArrayType(T.StringType()))]))),
    ])
    data = [(i + 1, p, b, [(k, l, a) for k, l, a in m], [(k, a) for k, a in ps])
            for i, (p, b, m, ps) in enumerate(rows)]
    return literal(spark, data, schema)


def peak_flops(spark: SparkSession) -> DataFrame:
    return literal(spark, PEAK_FLOPS, "ord INT, pattern STRING, flops DOUBLE")


def block_sizes(spark: SparkSession) -> DataFrame:
    return literal(spark, BLOCK_SIZES, "ord INT, pattern STRING, nb INT")


def size_classes(spark: SparkSession) -> DataFrame:
    return literal(spark, SIZE_CLASSES, "lo BIGINT, hi BIGINT, class STRING")


def sweep_sizes(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, lbl, disp, _size_bytes(lbl)) for i, (lbl, disp) in enumerate(SWEEP_SIZES)]
    return literal(spark, rows, "ord INT, block_size STRING, block_size_label STRING, bytes BIGINT")


def baseline(spark: SparkSession) -> DataFrame:
    """Published figures with the peaks they are compared to."""
    return literal(spark, BASELINE, "metric STRING, value DOUBLE, unit STRING, peak DOUBLE, other_peak DOUBLE")


def published_curve(spark: SparkSession, rw: str = "read") -> DataFrame:
    """The published curve of one direction: (curve_bytes, <rw>_mbs)."""
    i = 2 if rw == "read" else 1
    rows = [(_size_bytes(r[0]), r[i]) for r in BASELINE_SWEEP]
    return literal(spark, rows, f"curve_bytes BIGINT, {rw}_mbs DOUBLE")


def baseline_sweep(spark: SparkSession) -> DataFrame:
    """The published throughput curve, one row per (size, direction)."""
    rows = []
    for lbl, w, r in BASELINE_SWEEP:
        rows.append((lbl, _size_bytes(lbl), "write", w))
        rows.append((lbl, _size_bytes(lbl), "read", r))
    return literal(spark, rows, "block_size STRING, bytes BIGINT, rw STRING, mbs DOUBLE")
