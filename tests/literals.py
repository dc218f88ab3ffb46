"""Small literal tables, the same for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "completion_items": (
        "item int, ctx string, endings array<string>, label int",
        [
            (1, "The cat sat on the", ["mat", "mat and then slept for hours", "moon", "é"], 0),
            (2, "She opened the", ["door", "book", "door slowly", "x"], 1),
            (3, "Rain fell", ["a", "b", "c", "d"], 1),
            (4, "", ["one", "two", "three", "four"], 2),
            (5, "Numbers 12 and", ["13", "14", "a much longer ending than others", "15"], 0),
            (6, "In winter", ["snow", "sun", "sand", "sea"], 1),
        ],
    ),
    "four_choice": (
        "item int, question string, choices array<string>, answer int, subject string",
        [
            (1, "What is 2 + 2?", ["3", "4", "5", "6"], 1, "elementary_mathematics"),
            (2, "Capital of France?", ["Rome", "Oslo", "Paris", "Bern"], 2, "prehistory"),
            (3, "Broken", ["only", "three", "here"], 0, "virology"),
        ],
    ),
    "lettered": (
        "item int, question string, choices array<string>, letters array<string>, answer string",
        [
            (1, "Three?", ["a", "b", "c"], ["A", "B", "C"], "C"),
            (2, "Four?", ["w", "x", "y", "z"], ["1", "2", "3", "4"], "2"),
            (3, "Five?", ["p", "q", "r", "s", "t"], ["A", "B", "C", "D", "E"], "E"),
            (4, "Outside?", ["p", "q"], ["A", "B"], "D"),
            (5, "Shorter letters?", ["p", "q", "r"], ["A", "B"], "A"),
        ],
    ),
    "responses": ("item int, response string", [(1, "C"), (2, "3"), (3, "A"), (4, "A"), (5, "Z")]),
    "answers": (
        "item int, gold string, answer string",
        [
            (1, "so #### 42", "#### 42"), (2, "#### 42", "####42"), (3, "#### 1,234", "thus #### 1,234."), (4, "#### -5", "#### -5"), (5, "#### 5", "#### -"),
            (6, "#### 1.2", "#### 1.2.3"), (7, "#### 5", "#### $5"), (8, "#### 5", "none"), (9, "#### 7", "#### 7 then #### 8"), (10, "#### 8", "#### 7 then #### 8"),
            (11, "none", "none"), (12, "#### .5", "#### 0.5"), (13, "#### 10", "####\t10"), (14, "#### 3", "### 3"), (15, "#### 1000", "#### 1,000"),
        ],
    ),
    "rollouts": (
        "step int, example int, sample int, reward double, length int",
        [(s, e, k, float((s * 7 + e * 3 + k * 5) % 4 == 0 and s not in (3, 4, 5, 6, 9, 10, 11, 12, 13, 15, 16, 17, 18, 19, 20)), 20 + (s + 2 * e + 3 * k) % 9) for s in range(24) for e in range(3) for k in range(4)],
    ),
    "rollout_tokens": (
        "example int, sample int, prefix int, ids array<int>",
        [(1, 1, 3, [256, 65, 66, 10, 11, 12]), (1, 2, 3, [256, 65, 66, 20]), (1, 3, 3, [256, 65, 66, 30, 31, 32, 33, 34]), (2, 1, 2, [256, 70, 1]), (2, 2, 2, [256, 70, 2, 260, 3])],
    ),
    "objective_tokens": (
        "step int, logp double, adv double, target int",
        [(1, -0.5, 0.25, 65), (1, -1.5, 0.25, -100), (1, -2.0, -0.75, 66), (2, -0.1, 0.5, -100), (2, -0.2, 0.5, -100), (3, -1.25, 1.0, 1), (3, -0.75, 1.0, 2)],
    ),
    "logits": (
        "row int, token_id int, logit double",
        [(1, 0, 1.5), (1, 1, 3.0), (1, 2, 2.0), (1, 3, 2.0), (1, 4, 2.0), (1, 5, -1.0), (2, 0, 0.0), (2, 1, 0.0), (2, 2, 0.0), (3, 7, 5.0), (3, 9, 4.5), (3, 8, 4.5), (3, 1, -2.0)],
    ),
    "sampled": ("row int, ids array<int>", [(1, [5, 6, 260, 7]), (2, [260]), (3, [1, 2, 3]), (4, []), (5, [9, 260, 260])]),
    "log_lines": (
        "value string",
        [("0 train 4.123456",), ("1 train 3.500000 norm 0.9123",), ("1 val 3.4000",), ("2 val_bpb 1.0312",), ("3 pass@1 0.2500",), ("3 reward 0.1250 std 0.2165 len 181.5",), ("broken line",), ("4 train nan",), ("5 train inf norm 2.0000",), ("6 train 2.750000",)],
    ),
    "series": ("series string, step int, value double", [(n, s, v) for n in ("a", "b") for s, v in enumerate([4.0, 3.5, 3.75, 3.0, 2.5, 2.75, 2.0, 2.25])] + [("c", 0, 1.0), ("c", 2, 3.0), ("c", 3, 2.0)]),
    "rank_batches": ("rank int, batch_no int, loss double", [(r, b, 2.0 + ((r * 5 + b * 3) % 7) / 8) for r in range(3) for b in range(25)]),
    "devices": ("device string", [("NVIDIA H100 80GB HBM3",), ("NVIDIA H100 PCIe",), ("NVIDIA H200 NVL",), ("NVIDIA GB200",), ("NVIDIA L4",), ("NVIDIA L40S",), ("AMD Instinct MI300X",), ("Tesla K80",), ("NVIDIA A100-SXM4-80GB",)]),
    "checkpoint_files": ("path string", [("run/model_000100.pt",), ("run/model_999999.pt",), ("run/model_1000000.pt",), ("run/optim_2000000.pt",), ("run/meta_000100.json",)]),
    "model_tags": ("tag string, modified int", [("d12", 5), ("d4", 9), ("d20_wide", 1), ("other", 99)]),
    "untagged": ("tag string, modified int", [("alpha", 5), ("beta", 9), ("gamma", 1)]),
    "chats": (
        "conv_id long, turn long, role string, text string",
        [
            (1, 0, "user", "Hi"), (1, 1, "assistant", "Hello"), (2, 0, "system", "Be brief"), (2, 1, "user", "Why?"), (2, 2, "assistant", "Because é"), (3, 0, "user", "a"), (3, 1, "user", "b"),
            (4, 0, "system", "alone"), (5, 0, "user", "only"), (6, 0, "assistant", "first"), (6, 1, "user", "second"), (7, 0, "user", None), (7, 1, "assistant", "x"), (8, 0, "user", ""), (8, 1, "assistant", ""),
            (9, 0, "system", "s"), (9, 1, "assistant", "t"), (9, 2, "user", "u"),
        ],
    ),
    "packed_rows": ("row_no int, ids array<int>, mask array<int>", [(1, [256, 257, 65, 258, 259, 66, 260, 256], [0, 0, 0, 0, 0, 1, 1, 0]), (2, [256, 257, 65, 258, 256, 256, 256, 256], [0] * 8), (3, [256, 259, 260, 256, 259, 7, 8, 260], [0, 0, 1, 0, 0, 1, 1, 1])]),
    "configs": ("run string, n_layer int, window_pattern string", [("old", 2, "SSL"), ("new", 3, None)]),
}
TABLES["tie_losses"] = (
    "item int, choice int, label int, pos int, mask int, loss double",
    [
        (i, c, i % 4 if i != 3 else 1, p, int(p >= 2), v)
        for i, by_choice in {1: [[1, 1], [2], [1, 1], [4]], 2: [[3, 3, 3], [5], [2, 2], [9]], 3: [[1], [1], [1], [1]], 4: [[2, 4], [6], [7, 7], [8]], 5: [[8, 8], [3, 1], [2, 2], [5]]}.items()
        for c, losses in enumerate(by_choice)
        for p, v in enumerate([9.0, 9.0, *map(float, losses)])
    ],
)


def literal(spark: SparkSession, name: str) -> DataFrame:
    ddl, rows = TABLES[name]
    return spark.createDataFrame(rows, ddl)


_TYPES = {"int": "integer", "long": "bigint", "double": "double", "string": "varchar", "array<int>": "integer[]", "array<string>": "varchar[]"}


def _value(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, list):
        return "[" + ", ".join(map(_value, v)) + "]"
    return f"{v!r}::double" if isinstance(v, float) else str(v)


def cte(name: str) -> str:
    """The table as `name as (...)` for a WITH clause."""
    ddl, rows = TABLES[name]
    cols = [c.split(" ", 1) for c in ddl.split(", ")]
    values = ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)
    picked = ", ".join(f"{c}::{_TYPES[t]} {c}" for c, t in cols)
    return f"{name} as (select {picked} from (values {values}) t({', '.join(c for c, _ in cols)}))"
