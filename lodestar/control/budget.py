"""One deadline over staged phases: each phase gets what later floors leave, up to its cap."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Phase:
    """Phases of one stage run side by side; a stage's floor is its largest."""

    name: str
    stage: int
    cap_ns: int
    floor_ns: int = 0


@dataclass(frozen=True)
class Plan:
    phases: tuple[Phase, ...]
    margin_ns: int = 0

    def validate(self) -> None:
        names = [p.name for p in self.phases]
        if len(set(names)) < len(names):
            raise ValueError("a phase is named twice")
        for p in self.phases:
            if not 0 <= p.floor_ns <= p.cap_ns:
                raise ValueError(f"{p.name}: 0 <= floor <= cap does not hold")
        if [p.stage for p in self.phases] != sorted(p.stage for p in self.phases):
            raise ValueError("stages go backwards")

    def floor_after(self, stage: int) -> int:
        floors: dict[int, int] = {}
        for p in self.phases:
            if p.stage > stage:
                floors[p.stage] = max(floors.get(p.stage, 0), p.floor_ns)
        return sum(floors.values())

    def critical_path(self) -> int:
        caps: dict[int, int] = {}
        for p in self.phases:
            caps[p.stage] = max(caps.get(p.stage, 0), p.cap_ns)
        return sum(caps.values()) + self.margin_ns

    def scaled(self, total_ns: int) -> Plan:
        """Caps and floors shrunk in proportion so that the path fits; never grown."""
        path = self.critical_path() - self.margin_ns
        room = max(0, total_ns - self.margin_ns)
        if path <= room or not path:
            return self
        return Plan(tuple(Phase(p.name, p.stage, p.cap_ns * room // path, p.floor_ns * room // path) for p in self.phases), self.margin_ns)


@dataclass
class Budget:
    """A ledger of one run; all times are the caller's, in nanoseconds."""

    plan: Plan
    total_ns: int
    start_ns: int
    ledger: list[dict] = field(default_factory=list)

    def allowance(self, name: str, now_ns: int) -> int:
        p = next(p for p in self.plan.phases if p.name == name)
        left = self.start_ns + self.total_ns - now_ns - self.plan.margin_ns - self.plan.floor_after(p.stage)
        return max(0, min(p.cap_ns, left))

    def begin(self, name: str, now_ns: int) -> int:
        """Time given; 0 means the phase is skipped."""
        if any(r["phase"] == name for r in self.ledger):
            raise ValueError(f"{name} began before")
        given = self.allowance(name, now_ns)
        self.ledger.append({"phase": name, "given_ns": given, "begun_ns": now_ns, "ended_ns": None, "status": "running" if given else "skipped"})
        return given

    def end(self, name: str, now_ns: int, failed: bool = False) -> None:
        row = next(r for r in self.ledger if r["phase"] == name and r["status"] == "running")
        over = now_ns - row["begun_ns"] > row["given_ns"]
        row.update(ended_ns=now_ns, status="failed" if failed else "overrun" if over else "done")

    def finalize(self, now_ns: int) -> list[dict]:
        """The ledger, with phases still running as abandoned and those never begun as missing."""
        for r in self.ledger:
            if r["status"] == "running":
                r.update(ended_ns=now_ns, status="abandoned")
        seen = {r["phase"] for r in self.ledger}
        return self.ledger + [{"phase": p.name, "given_ns": 0, "begun_ns": None, "ended_ns": None, "status": "missing"} for p in self.plan.phases if p.name not in seen]
