"""What steers a delivery: profiles, limits, the controller of prefetching, and what it tells people."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIB, GIB = 1 << 20, 1 << 30


@dataclass(frozen=True)
class Profile:
    """What is in flight, queued and fetched ahead at first, and the rails of the last three; memory: the share of a machine's that may be used."""

    inflight: int
    queue: int
    ahead: int
    rails_ahead: tuple[int, int]
    rails_queue: tuple[int, int]
    rails_leases: tuple[int, int]
    memory: float


PROFILES = {"safe": Profile(128 * MIB, 32, 1, (1, 4), (8, 64), (1, 2), 0.60), "balanced": Profile(256 * MIB, 64, 2, (1, 8), (16, 128), (1, 4), 0.75), "throughput": Profile(512 * MIB, 128, 4, (2, 16), (32, 256), (1, 8), 0.85)}


def memory_limit(profile: str, inflight: int, machine: int | None, used: int = 0) -> int:
    """The memory that a process may take: its profile's share of the machine less 1 GiB, but never less than what it has and has in flight."""
    least = used + inflight
    share = int(max(1.0, machine * PROFILES[profile].memory)) - GIB if machine else least + GIB
    return max(share, least, inflight, 1)


@dataclass(frozen=True)
class Knobs:
    ahead: int
    queue: int
    leases: int


@dataclass
class Controller:
    """A PID over memory, with additive increase and multiplicative decrease of what is fetched ahead, after a probe of a few readings."""

    profile: Profile
    wait: float = 0.0
    rss: float = 0.0
    last_rss: float = 0.0
    integral: float = 0.0
    rest: int = 0
    ups: int = 0
    hold: int = 0
    guard: int = 0
    phase: str = "sampling"
    readings: list[tuple[float, float, float]] = field(default_factory=list)
    target: Knobs | None = None
    blends: int = 0

    def tick(self, now: Knobs, wait: float, rss: float, inflight: float, net: float = 0.0, seconds: float = 1.0) -> tuple[Knobs, str, float]:
        """(the next knobs, why, how pressed it is)."""
        p, leases_cap = self.profile, max(self.profile.rails_leases[0], int(self.profile.rails_leases[1] * 0.8))
        self.wait, self.rss = 0.2 * wait + 0.8 * self.wait, 0.2 * rss + 0.8 * self.rss
        error = self.rss - 0.90
        self.integral = min(0.5, max(-0.5, self.integral + error * seconds))
        slope = 0.0 if self.hold else (self.rss - self.last_rss) / seconds
        self.hold, self.last_rss = max(0, self.hold - 1), self.rss
        memory = min(1.0, max(0.0, 1.5 * error + 0.2 * self.integral + 0.1 * slope))
        press = max(memory, min(1.0, max(0.0, net)))
        new, why = now, "hold"
        if rss >= 0.97 or inflight >= 0.98:
            new, why = Knobs(int(now.ahead * 0.5), int(now.queue * 0.7), int(now.leases * 0.5)), "hard_cut"
            self.rest, self.phase, self.guard = 2, "done", 0
        elif self.phase != "done" and (rss >= 0.92 or inflight >= 0.90):
            new, why = Knobs(p.rails_ahead[0], p.rails_queue[0], p.rails_leases[0]), "probe_cut"
            self.rest, self.phase, self.guard, self.integral, self.hold = 2, "done", 0, 0.0, 1
        elif press >= 0.60:
            new, why = Knobs(max(0, now.ahead - 1), max(0, now.queue - 2), now.leases), "soft_cut_net" if net > memory else "soft_cut"
            self.ups = 0
        elif self.phase == "sampling":
            self.readings.append((wait, rss, inflight))
            why, n = "probe_sampling", len(self.readings)
            if n >= 8 or (n >= 6 and self.wait > 0.05 and self.rss < 0.85 and inflight < 0.85):
                self.target, self.phase, self.blends, self.guard, why = self._aim(now, leases_cap), "blending", 4, 4, "probe_ready"
        elif self.phase == "blending":
            step = lambda a, b, by: a + by if a < b else a - by if a > b else a
            new, why = Knobs(step(now.ahead, self.target.ahead, 1), step(now.queue, self.target.queue, 2), step(now.leases, self.target.leases, 1)), "probe_blend"
            self.blends -= 1
            if self.blends <= 0 or new == self.target:
                self.phase, self.hold, self.integral = "done", 1, min(0.25, max(-0.25, self.integral))
        elif not self.rest and self.wait > 0.05 and press <= 0.30 and inflight <= 0.85:
            new, why = Knobs(now.ahead + 1, now.queue + 2, now.leases + self.ups % 2), "increase"
            self.ups += 1
        else:
            self.ups, self.rest = 0, max(0, self.rest - 1)
        if self.guard:
            new, self.guard = replace(new, leases=min(new.leases, leases_cap)), self.guard - 1
        clip = lambda x, rails: min(max(x, rails[0]), rails[1])
        return Knobs(clip(new.ahead, p.rails_ahead), clip(new.queue, p.rails_queue), clip(new.leases, p.rails_leases)), why, press

    def _aim(self, now: Knobs, leases_cap: int) -> Knobs:
        """What the probe says: further up the more it waited and the more room there was, nearer to now the fewer and the less steady the readings."""
        p, n = self.profile, len(self.readings)
        wait, rss, inflight = (sum(r[k] for r in self.readings) / n for k in range(3))
        spread = max(r[2] for r in self.readings) - min(r[2] for r in self.readings)
        sure = 0.7 * min(1.0, n / 8) + 0.3 * max(0.0, 1 - spread / 0.5)
        full = max(rss, inflight)
        gain = min(1.0, wait / 0.12) * min(1.0, max(0.0, (0.9 - full) / 0.9))
        whole = lambda x: int(x + 0.5)
        less = 1 if full > 0.85 else 0
        clip = lambda x, lo, hi: min(max(x, lo), hi)
        aim = (
            clip(now.ahead + whole(max(0, p.rails_ahead[1] - now.ahead) * gain) - less, *p.rails_ahead),
            clip(now.queue + whole(max(0, p.rails_queue[1] - now.queue) * gain * 0.25) - 2 * less, *p.rails_queue),
            clip(now.leases + whole(max(0, leases_cap - now.leases) * gain) - less, p.rails_leases[0], leases_cap),
        )
        base = (now.ahead, now.queue, min(now.leases, leases_cap))
        mixed = [whole(max(0.0, sure * a + (1 - sure) * b)) for a, b in zip(aim, base, strict=True)]
        return Knobs(clip(mixed[0], *p.rails_ahead), clip(mixed[1], *p.rails_queue), clip(mixed[2], p.rails_leases[0], leases_cap))


def pressure_class(x: Column) -> Column:
    return F.when(x >= 0.85, "HIGH").when(x >= 0.60, "WARM").otherwise("STABLE")


def readable_bytes(x: Column) -> Column:
    unit = lambda by, name: F.concat(F.format_string("%.2f", F.bround(x / F.lit(float(by)), 2)), F.lit(name))
    return F.when(x >= GIB, unit(GIB, "GiB")).when(x >= MIB, unit(MIB, "MiB")).when(x >= 1024, unit(1024, "KiB")).otherwise(F.concat(x.cast("string"), F.lit("B")))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, "-").otherwise(F.format_string("%.1f%%", part * 100.0 / whole))


def delivery_stats(batches: DataFrame) -> DataFrame:
    """One row of counters over delivered batches (n, bytes): batches, samples, bytes, and the least, greatest and mean batch."""
    return batches.agg(F.count("*").alias("batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("samples"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.min("bytes").alias("least"), F.max("bytes").alias("most"), F.expr("sum(bytes) div count(*)").alias("mean"))


def cluster_summary(reports: DataFrame, now_of: str = "seen", stale: int = 5_000, stalled: int = 10_000) -> DataFrame:
    """(node, reports, inflight, last_seen, stale, stalled) from reports (node, seen, inflight, moved): stale if its last report, stalled if its last progress is too long before the last of all."""
    nodes = reports.groupBy("node").agg(F.count("*").alias("reports"), F.sum("inflight").alias("inflight"), F.max(now_of).alias("last_seen"), F.max("moved").alias("_moved"))
    last = reports.agg(F.max(now_of).alias("_now"))
    return nodes.crossJoin(F.broadcast(last)).select("node", "reports", "inflight", "last_seen", (F.col("last_seen") < F.col("_now") - stale).alias("stale"), (F.coalesce("_moved", F.lit(-1)) < F.col("_now") - stalled).alias("stalled"))  # of one row


def durations(rows: DataFrame, by: str, ms: str) -> DataFrame:
    """(by, n, total, most, mean): mean in whole units."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(ms).alias("total"), F.max(ms).alias("most"), F.expr(f"sum({ms}) div count({ms})").alias("mean"))


def human_stats(stats: dict) -> str:
    """A few lines about a delivery from its counters: samples done of all, seconds, bytes, memory and how pressed it is."""
    done, total, seconds, size = (stats.get(k, 0) for k in ("samples", "total", "seconds", "bytes"))
    rss, limit, ratio = stats.get("rss", 0), stats.get("limit", 0), stats.get("ratio_milli", 0)
    press = max(rss / limit if limit else 0.0, stats.get("net", 0.0))
    named = "HIGH" if press >= 0.85 else "WARM" if press >= 0.60 else "STABLE"
    rate = done / seconds if seconds else 0.0
    state = "done" if total and done >= total else "running" if done else "starting"
    return "\n".join([
        f"state: {state}, {stats.get('profile', 'balanced')}", f"progress: {done} of {total or '?'}{f' ({100 * done / total:.1f}%)' if total else ''}", f"speed: {rate:.1f} samples/s, {size / MIB / seconds if seconds else 0:.2f} MiB/s",
        f"memory: {rss / GIB:.2f} GiB of {limit / GIB:.2f} GiB, {named}", f"batch sizes: p95 is {ratio / 1000:.2f} x p50" + (", over 1.25" if ratio > 1250 else ""),
    ])
