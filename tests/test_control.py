import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from quadrivo.control import config, scheduler
from quadrivo.control.ledger import MemoryLedger, Result, WarehouseLedger
from quadrivo.control.scheduler import Agenda, Answer, Outcome, Scheduler, Trigger
from quadrivo.control.lease import Held, Lease
from quadrivo.sources.warehouse import Warehouse


class Job:
    def __init__(self, work=True, fails=0):
        self.work, self.fails, self.ran = work, fails, []

    def has_work(self):
        if isinstance(self.work, Exception):
            raise self.work
        return self.work

    def run(self, trigger, should_stop):
        self.ran.append(trigger.value)
        if self.fails:
            self.fails -= 1
            raise RuntimeError("wstoken=abc&")
        return Result(3, "detail token=s")


class Clock:
    def __init__(self):
        self.now = dt.datetime(2026, 9, 1, 17, 43, tzinfo=ZoneInfo("America/Santo_Domingo"))

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += dt.timedelta(seconds=seconds)

    def monotonic(self):
        return self.now.timestamp()


def made(conf="", **jobs):
    clock, alerts = Clock(), []
    s = Scheduler({name: jobs.get(name) or Job() for name in config.JOBS}, config.parse(conf), MemoryLedger(), lambda *a: alerts.append(a), clock, clock.sleep, clock.monotonic)
    s.alerts, s.time = alerts, clock
    return s


def rows(s):
    return [(r["job"], r["trigger"], r["attempt"], r["status"]) for r in s.ledger.rows]


def test_agenda_is_a_pure_function_of_events():
    conf, now = config.parse("[notifications]\nenabled = false"), Clock().now
    a = scheduler.opened(Agenda(), now, conf)
    assert a.waiting == (("moodle_sync", Trigger.STARTUP),) and set(a.slots) == {"moodle_sync"}
    b, entry = scheduler.begun(a)
    assert entry == ("moodle_sync", Trigger.STARTUP) and b.running == "moodle_sync" and a.running is None
    assert scheduler.asked(b, "moodle_sync", Trigger.MANUAL, conf) == (b, Answer.DUPLICATE)
    assert scheduler.asked(b, "notifications", Trigger.INTERVAL, conf)[1] is Answer.DISABLED and scheduler.asked(b, "notifications", Trigger.MANUAL, conf)[1] is Answer.ACCEPTED
    c = scheduler.ended(b, "moodle_sync", Outcome.SKIPPED, conf)
    assert c.waiting == (("ingestion", Trigger.DEPENDENCY),) and c.running is None
    d = scheduler.asked(c, "extraction", Trigger.MANUAL, conf)[0]
    assert scheduler.ended(d, "moodle_sync", Outcome.FAILED, conf).waiting == (("extraction", Trigger.MANUAL),)
    assert scheduler.ended(d, "moodle_sync", Outcome.STOPPED, conf).waiting == d.waiting
    late = scheduler.ticked(c, now + dt.timedelta(days=3), conf)
    assert [j for j, _ in late.waiting] == ["ingestion", "moodle_sync"] and late.slots["moodle_sync"] > now + dt.timedelta(days=3)
    assert scheduler.begun(Agenda()) == (Agenda(), None) and scheduler.patience(Agenda(), now) == scheduler.POLL_SECONDS


def test_startup_chain_and_grid():
    s = made()
    s.open()
    s.drain()
    assert rows(s) == [("moodle_sync", "startup", 1, "done"), ("ingestion", "dependency", 1, "done"), ("extraction", "dependency", 1, "done")]
    assert s.ledger.rows[0]["detail"] == "detail token=***" and s.ledger.rows[0]["items"] == 3
    assert {k: v.hour for k, v in s.agenda.slots.items()} == {"moodle_sync": 18, "notifications": 18}
    s.time.now = s.time.now.replace(hour=23, minute=5)
    s.drain()
    assert [r[0] for r in rows(s)[3:]] == ["moodle_sync", "notifications", "ingestion", "extraction"]
    assert s.agenda.slots["moodle_sync"].hour == 0 and s.agenda.slots["notifications"].hour == 0


def test_failures():
    s = made("retry_delay_seconds = 7", moodle_sync=Job(fails=1), ingestion=Job(fails=9))
    s.ask("moodle_sync")
    s.ask("extraction", Trigger.DEPENDENCY)
    before = s.time.now
    s.drain()
    assert rows(s) == [("moodle_sync", "manual", 1, "failed"), ("moodle_sync", "manual", 2, "done"), ("extraction", "dependency", 1, "done"), *[("ingestion", "dependency", i, "failed") for i in (1, 2, 3)]]
    assert s.ledger.rows[0]["error"] == "RuntimeError: wstoken=***&" and s.time.now - before >= dt.timedelta(seconds=21)
    assert [a[0] for a in s.alerts] == ["ingestion"]


def test_failed_upstream_cancels_dependents_only():
    s = made("retry_delay_seconds = 0", moodle_sync=Job(fails=3))
    s.ask("moodle_sync")
    s.ask("ingestion", Trigger.DEPENDENCY)
    s.ask("extraction")
    s.drain()
    assert [r[0] for r in rows(s)] == ["moodle_sync"] * 3 + ["extraction"]


def test_skips_and_unknown_work():
    s = made("retry_delay_seconds = 0", ingestion=Job(work=False), notifications=Job(work=RuntimeError("x")))
    s.ask("moodle_sync")
    s.ask("notifications", Trigger.INTERVAL)
    s.drain()
    assert rows(s) == [("moodle_sync", "manual", 1, "done"), *[("notifications", "interval", i, "failed") for i in (1, 2, 3)], ("extraction", "dependency", 1, "done")]
    assert "can't tell whether it has work" in s.ledger.rows[1]["error"]


def test_requests():
    s = made("allow_manual_disabled_jobs = false\n[ingestion]\nenabled = false")
    assert s.ask("moodle_sync") is Answer.ACCEPTED and s.ask("moodle_sync") is Answer.DUPLICATE and s.ask("ingestion") is Answer.DISABLED
    with pytest.raises(ValueError):
        s.ask("nothing")
    s.drain()
    assert [r[0] for r in rows(s)] == ["moodle_sync"]
    s.ledger.requests += [("moodle_sync", "2026-01-01"), ("unknown", "2026"), ("extraction", "2999")]
    s.drain()
    assert [r[0] for r in rows(s)] == ["moodle_sync", "extraction"] and not s.ledger.requests


def test_recovery_and_stop():
    s = made()
    s.ledger.begin("extraction", "manual", 1, "2020")
    s.ledger.requests.append(("extraction", "2020"))
    s.open(daemon=False)
    assert rows(s) == [("extraction", "manual", 1, "failed")] and not s.ledger.requests and not s.agenda.waiting
    s.ask("moodle_sync")
    s.stop()
    s.drain()
    assert len(rows(s)) == 1
    with pytest.raises(ValueError):
        Scheduler({}, config.Config(), MemoryLedger())


def test_shutdown_is_recorded():
    job = Job()
    job.run = lambda *a: (_ for _ in ()).throw(KeyboardInterrupt())
    s = made(extraction=job)
    s.ask("extraction")
    with pytest.raises(KeyboardInterrupt):
        s.turn()
    assert s.ledger.rows[0]["status"] == "failed" and "process ended" in s.ledger.rows[0]["error"] and s.agenda.running is None


def test_daemon_waits_for_slots():
    s = made(moodle_sync=Job(work=False))
    s.agenda = Agenda(slots={"notifications": scheduler.next_slot(s.time.now, 1)})
    s.jobs["notifications"].run = lambda *a: (s.stop(), Result())[1]
    s.serve()
    assert (s.time.now.hour, s.time.now.minute) == (18, 0)


def test_a_stop_during_the_pause_ends_the_job():
    s = made("retry_delay_seconds = 60", extraction=Job(fails=3))
    s.ask("extraction")
    s.sleep = lambda seconds: s.stop()
    s.drain()
    assert rows(s) == [("extraction", "manual", 1, "failed")] and not s.alerts


def test_ledger_of_the_warehouse(spark, tmp_path):
    """Attempts are rows that are added and closed one by one; requests of another process are taken up once, and lapse at a start."""
    w = Warehouse(spark, f"file://{tmp_path}/w")
    book = WarehouseLedger(w)
    assert book.take_requests() == [] and book.last_status("extraction") is None and book.fail_open("t") == 0
    first = book.begin("extraction", "manual", 1, "2026-01-01T00:00:00")
    book.end(first, "done", "2026-01-01T00:01:00", 60.0, Result(4, "four"))
    second = book.begin("extraction", "manual", 1, "2026-01-02T00:00:00")
    assert (first, second) == (1, 2) and book.last_status("extraction") == "running"
    assert book.fail_open("2026-01-03T00:00:00") == 1 and book.last_status("extraction") == "failed"
    assert [(r.id, r.status, r.items_processed) for r in w["executions"].orderBy("id").collect()] == [(1, "done", 4), (2, "failed", None)]
    other = Warehouse(spark, f"file://{tmp_path}/w")
    other.ask("extraction", "2026-01-02T12:00:00")
    other.ask("moodle_sync", "2026-01-04T00:00:00")
    assert w["requests"].count() == 2
    assert book.take_requests() == [("extraction", True), ("moodle_sync", False)] and book.take_requests() == []
    other.ask("ingestion", "2026-01-05T00:00:00")
    assert book.drop_requests() == 1 and w["requests"].count() == 0
    with pytest.raises(ValueError):
        w.commit({"requests": w["requests"]})


def test_lease(spark, tmp_path):
    clock = [100.0]
    w = Warehouse(spark, f"file://{tmp_path}/w")
    a, b, c = (Lease(w, seconds=10, now=lambda: clock[0]) for _ in range(3))
    assert not a.taken()
    with a:
        assert b.taken()
        with pytest.raises(Held), b:
            raise AssertionError("two have it")
        clock[0] += 8
        a.renew()
        clock[0] += 8
        assert b.taken() and not a.lost
    assert not b.taken()
    with b:  # a process that is killed renews nothing; its term runs out, and it finds that another one has the warehouse
        clock[0] += 11
        assert not c.taken()
        with c:
            b.renew()
            assert b.lost and not c.lost and c.taken()
        assert c.term == b.term + 1
    assert not a.taken() and len(w.files("lease").names()) == 1


def test_a_term_is_made_once(spark, tmp_path):
    files = Warehouse(spark, f"file://{tmp_path}/w").files("lease")
    assert files.names() == [] and files.read("x") is None
    assert files.create("x", "a") and not files.create("x", "b") and files.read("x") == "a"
    files.replace("x", "c")
    assert files.read("x") == "c" and files.names() == ["x"]


def test_course_of_a_job():
    c = scheduler.Course()
    assert c.next(False) is scheduler.Step.TRY and c.next(True) is scheduler.Outcome.STOPPED
    for n in range(1, scheduler.ATTEMPTS):
        c = c.tried(scheduler.Outcome.FAILED, f"e{n}")
        assert c.next(False) is scheduler.Step.PAUSE and c.next(True) is scheduler.Outcome.STOPPED
        c = c.paused()
        assert c.next(False) is scheduler.Step.TRY
    last = c.tried(scheduler.Outcome.FAILED, "last")
    assert last.next(False) is last.next(True) is scheduler.Outcome.FAILED and last.error == "last"
    for end in (scheduler.Outcome.SUCCEEDED, scheduler.Outcome.SKIPPED):
        assert c.tried(end, None).next(True) is end


def test_config():
    c = config.parse('timezone = "UTC"\n[extraction]\nmax_items = 5\n[[reminders]]\nid = "a"\nhours_before = 2\ntitle = "{assignment}"')
    assert c.jobs["extraction"].max_items == 5 and c.jobs["extraction"].max_seconds == 1800 and c.reminders[0].offset_seconds == 7200 and c.schedules == {"moodle_sync": 6, "notifications": 1}
    assert config.parse("").reminders == config.RULES and config.parse("reminders = []").reminders == ()
    for bad in ("x = 1", "[ingestion]\ninterval_hours = 1", "[moodle_sync]\ninterval_hours = 5", "[extraction]\nmax_items = 0", "[extraction]\nenabled = 1", "timezone = 'Nowhere/X'", "= ", "[[reminders]]\nid = 'a'", "[[reminders]]\nid = 'a'\nhours_before = 1\nmore = 2", "moodle_sync = 3", "retry_delay_seconds = -1"):
        with pytest.raises(ValueError):
            config.parse(bad)
