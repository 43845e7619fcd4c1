"""Request checks made on the driver before a plan is built."""

from __future__ import annotations

MOST_BUCKETS = 2000
MOST_HASHES = 1000
MOST_PAGE = 1000


class RequestError(ValueError):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def height_at_most(height: int, stable: int) -> int:
    if height > stable:
        raise RequestError("HEIGHT_NOT_SYNCED", f"{height} > {stable}")
    return height


def filled_range(start: int, end: int) -> tuple[int, int]:
    if start >= end:
        raise RequestError("INVALID_RANGE", f"[{start}, {end})")
    return start, end


def inclusive_range(first: int, last: int) -> tuple[int, int]:
    if first > last:
        raise RequestError("INVALID_RANGE", f"{first}..={last}")
    return first, last


def bucket_size(start: int, end: int, size: int) -> int:
    filled_range(start, end)
    if size <= 0 or -(-(end - start) // size) > MOST_BUCKETS:
        raise RequestError("INVALID_BUCKETS", f"size {size}")
    return size


def chart_bucket(span: int, points: int = 160) -> int:
    return max(1, -(-span // points))


def batch(keys: list) -> list:
    if len(keys) > MOST_HASHES:
        raise RequestError("TOO_MANY_HASHES", str(len(keys)))
    return keys


def page(number: int, size: int) -> tuple[int, int]:
    """Offset and limit of a zero-based page."""
    if number < 0 or not 1 <= size <= MOST_PAGE or number * size > 2**63 - 1:
        raise RequestError("INVALID_PAGINATION", f"page {number} of {size}")
    return number * size, size


def states(names: list[str] | None, known: tuple[str, ...]) -> list[str]:
    """Trimmed, without blanks and repeats; an unknown one is an error. Empty means no filter."""
    out = list(dict.fromkeys(n.strip().lower() for n in names or [] if n.strip()))
    if bad := [n for n in out if n not in known]:
        raise RequestError("INVALID_STATE", bad[0])
    return out


def descending(order: str | None, default: bool) -> bool:
    if order is None:
        return default
    if order not in ("asc", "desc"):
        raise RequestError("INVALID_ORDER", order)
    return order == "desc"


def retained(height: int, genesis: int) -> int:
    if height < genesis:
        raise RequestError("STATE_NOT_RETAINED", f"{height} < {genesis}")
    return height


#: Selectors of an expected state in the order in which a mismatch is reported.
SELECTORS = (("snapshot_id", "SNAPSHOT_ID_MISMATCH"), ("stable_block_hash", "BLOCK_HASH_MISMATCH"), ("versions", "VERSION_MISMATCH"), ("local_state_commit", "LOCAL_STATE_COMMIT_MISMATCH"), ("system_state_id", "SYSTEM_STATE_ID_MISMATCH"))


def expected_state(expected: dict, actual: dict) -> None:
    """Compares only the selectors that the caller supplied."""
    for name, code in SELECTORS:
        if expected.get(name) is not None and expected[name] != actual.get(name):
            raise RequestError(code, name)


def readiness(facts: dict) -> dict:
    """Blockers and readiness flags from metadata facts."""
    blockers = [code for code, bad in (
        ("RPC_NOT_LISTENING", not facts.get("rpc_alive", True)), ("ROLLBACK_IN_PROGRESS", facts.get("rollback", False)), ("CATCHING_UP", facts.get("synced", 0) < facts.get("target", 0)),
        ("SNAPSHOT_MISSING", facts.get("snapshot_height") is None), ("SHUTTING_DOWN", facts.get("stopping", False)),
    ) if bad]
    hard = {"RPC_NOT_LISTENING", "ROLLBACK_IN_PROGRESS", "SHUTTING_DOWN"}
    return {"blockers": blockers, "query_ready": not hard & set(blockers), "consensus_ready": not blockers}
