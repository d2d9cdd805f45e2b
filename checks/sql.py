"""SQL text for the portable draws and the rounding rules."""

from __future__ import annotations

from checks.registry import SEED

AS_OF = "TIMESTAMP '2024-06-01 00:00:00'"


def hexes(field: str, key: str, block: int = 0, attempt: str = "0") -> str:
    tag = field if block == 0 else f"{field}#{block}"
    return f"md5('{SEED}|{tag}|' || CAST({key} AS VARCHAR) || '|' || '{attempt}')"


def u32(field: str, key: str, slot: int = 0, attempt: str = "0") -> str:
    return f"CAST('0x' || substr({hexes(field, key, slot // 4, attempt)}, {8 * (slot % 4) + 1}, 8) AS BIGINT)"


def below(n: int, field: str, key: str, slot: int = 0, attempt: str = "0") -> str:
    return f"(({u32(field, key, slot, attempt)} * {n}) // 4294967296)"


def between(low: int, high: int, field: str, key: str, slot: int = 0) -> str:
    return f"({low} + {below(high - low + 1, field, key, slot)})"


def cents(low: float, high: float, field: str, key: str, attempt: str = "0") -> str:
    first, last = round(low * 100), round(high * 100)
    return f"(CAST({first} + {below(last - first + 1, field, key, 0, attempt)} AS DOUBLE) / 100.0::DOUBLE)"


def rounded(x: str, digits: int = 2) -> str:
    return f"(floor(({x}) * {10**digits}::DOUBLE + 0.5::DOUBLE) / {10**digits}::DOUBLE)"


def choice(options: list[str], weights: list[float], field: str, key: str, attempt: str = "0") -> str:
    """Options are SQL expressions."""
    total, running, arms = sum(weights), 0.0, []
    for option, weight in zip(options[:-1], weights):
        running += weight
        arms.append(f"WHEN {u32(field, key, 0, attempt)} < {round(running / total * 4294967296)} THEN {option}")
    return f"(CASE {' '.join(arms)} ELSE {options[-1]} END)"


def texts(words: list[str]) -> list[str]:
    return ["'" + w.replace("'", "''") + "'" for w in words]


def standard_normal(field: str, key: str) -> str:
    u = f"(({u32(field, key, 0)} + 1) / 4294967296.0::DOUBLE)"
    v = f"({u32(field, key, 1)} / 4294967296.0::DOUBLE)"
    return f"(sqrt(-2.0::DOUBLE * ln({u})) * cos(6.283185307179586::DOUBLE * {v}))"


def seconds_later(ts: str, seconds: str) -> str:
    return f"({ts} + to_seconds({seconds}))"


def canonical(x: str) -> str:
    return f"replace(replace(lower(trim({x})), ' ', '_'), '-', '_')"
