"""The pass machine as a plain loop over events in canonical order, which the joins of operators/fsm.py are held against."""

from heightline.functions.energy import GROWTH, PENALTY, THRESHOLD
from heightline.schema import U64_MAX

RANK = {"balance": 0, "mint": 1, "transfer": 1, "burn": 1, "invalid_mint": 2}


def growth(balance: int, blocks: int) -> int:
    return 0 if balance < THRESHOLD else min(U64_MAX, balance * GROWTH * blocks)


def grown(record: dict, height: int) -> int:
    if record["state"] != "active" or height <= record["height"]:
        return record["energy"]
    more = growth(record["balance"], height - record["active"]) - growth(record["balance"], record["height"] - record["active"])
    return min(U64_MAX, record["energy"] + max(0, more))


class Machine:
    def __init__(self, strict: bool = False, whole_prev: bool = False):
        self.passes: dict[str, dict] = {}
        self.active: dict[str, dict[str, None]] = {}  # of each owner the active passes, oldest first
        self.energy: dict[str, dict] = {}
        self.balances: dict[str, tuple[int, int, int]] = {}
        self.log: list[tuple] = []
        self.strict, self.whole_prev = strict, whole_prev

    def put(self, name: str, new: dict) -> None:
        """Sets a pass and keeps the owners' active passes."""
        old = self.passes.get(name)
        if old and old["state"] == "active":
            self.active[old["owner"]].pop(name, None)
        self.passes[name] = new
        if new["state"] == "active":
            self.active.setdefault(new["owner"], {})[name] = None

    def note(self, height, name, kind, old, new) -> None:
        record = self.energy.get(name)
        self.log.append((len(self.log), height, name, kind, old.get("state"), new["state"], old.get("owner"), new["owner"], old.get("satpoint"), new["satpoint"], record and record["energy"]))

    def settle(self, name: str, height: int, zero_too: bool) -> None:
        """Applies the owner's balance row of this height, once."""
        record, held = self.energy[name], self.passes[name]
        row = self.balances.get(held["owner"])
        if record["state"] != "active" or not row or row[0] != height or record["height"] >= height or not (row[2] or zero_too):
            return
        energy = grown(record, height)
        if row[2] < 0:
            energy = max(0, energy - min(U64_MAX, -row[2] * PENALTY))
        self.energy[name] = {"state": "active", "height": height, "active": height if row[2] < 0 else record["active"], "balance": row[1], "delta": row[2], "energy": energy}

    def dormant(self, name: str, height: int) -> None:
        self.settle(name, height, True)
        record = self.energy[name]
        self.energy[name] = record | {"energy": grown(record, height), "state": "dormant", "height": height, "delta": record["delta"] if record["height"] == height else 0}
        old = self.passes[name]
        self.put(name, old | {"state": "dormant"})
        self.note(height, name, "state_update", old, self.passes[name])

    def inheritable(self, e) -> bool:
        """Whether every predecessor is there, the owner's, dormant once its active pass is, and named once."""
        held = [self.passes.get(p) for p in e.prev or []]
        return len(set(e.prev or [])) == len(held) and all(h and h["owner"] == e.owner and h["state"] in ("active", "dormant") for h in held)

    def mint(self, e, height: int) -> None:
        if self.whole_prev and not self.inheritable(e):
            self.invalid_mint(e, height)
            return
        for name in list(self.active.get(e.owner, ())):
            self.dormant(name, height)
        new = {"state": "active", "owner": e.owner, "satpoint": e.satpoint}
        self.put(e.inscription_id, new)
        inherited = 0
        consumed = []
        for prev in e.prev if e.prev is not None else []:
            held = self.passes.get(prev)
            if held and held["owner"] == e.owner and held["state"] == "dormant":
                inherited = min(U64_MAX, inherited + self.energy[prev]["energy"])
                self.energy[prev] = {"state": "consumed", "height": height, "active": height, "balance": 0, "delta": 0, "energy": 0}
                self.put(prev, held | {"state": "consumed"})
                consumed.append((prev, held))
        _, balance, delta = self.balances.get(e.owner, (0, 0, 0))
        self.energy[e.inscription_id] = {"state": "active", "height": height, "active": height, "balance": balance, "delta": delta, "energy": inherited}
        self.note(height, e.inscription_id, "mint", {}, new)
        for prev, held in consumed:
            self.note(height, prev, "state_update", held, self.passes[prev])

    def transfer(self, e, height: int) -> None:
        old = self.passes.get(e.inscription_id)
        if old is None:
            raise ValueError(f"pass {e.inscription_id} not found for transfer at {height}")
        if old["state"] == "active":
            self.settle(e.inscription_id, height, True)
        if old["owner"] == e.owner:
            self.put(e.inscription_id, old | {"satpoint": e.satpoint})
            self.note(height, e.inscription_id, "satpoint_update", old, self.passes[e.inscription_id])
            return
        if old["state"] == "active":
            self.dormant(e.inscription_id, height)
            old = self.passes[e.inscription_id]
        self.put(e.inscription_id, old | {"owner": e.owner, "satpoint": e.satpoint})
        self.note(height, e.inscription_id, "owner_transfer", old, self.passes[e.inscription_id])

    def burn(self, e, height: int) -> None:
        old = self.passes.get(e.inscription_id)
        if old is None:
            raise ValueError(f"pass {e.inscription_id} not found for burning at {height}")
        if old["state"] == "active":
            self.settle(e.inscription_id, height, True)
        if self.strict and e.inscription_id in self.energy:
            self.energy[e.inscription_id] |= {"state": "burned", "energy": 0, "height": height}
        self.put(e.inscription_id, old | {"state": "burned"})
        self.note(height, e.inscription_id, "state_update", old, self.passes[e.inscription_id])

    def invalid_mint(self, e, height: int) -> None:
        self.put(e.inscription_id, {"state": "invalid", "owner": e.owner, "satpoint": e.satpoint})
        self.note(height, e.inscription_id, "invalid_mint", {}, self.passes[e.inscription_id])

    def block(self, height: int, events: list) -> None:
        """Balances are known first, events follow in order, invalid mints come last, then owners settle."""
        moved = []
        for e in events:
            if e.op == "balance":
                self.balances[e.owner] = (height, int(e.balance), int(e.delta))
                moved.append(e.owner)
            else:
                getattr(self, e.op)(e, height)
        for owner in dict.fromkeys(moved):
            for name in self.active.get(owner, ()):
                self.settle(name, height, False)


def replay(rows, strict: bool = False, whole_prev: bool = False) -> list[tuple]:
    """The log without its sequence numbers. rows: events with the attributes of the columns."""
    machine = Machine(strict, whole_prev)
    rows = sorted(rows, key=lambda e: (e.height, RANK[e.op], e.event_order, e.inscription_id or ""))
    for height in sorted({e.height for e in rows}):
        machine.block(height, [e for e in rows if e.height == height])
    return [x[1:] for x in machine.log]
