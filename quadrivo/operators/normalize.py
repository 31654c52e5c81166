"""Nested payloads of the platform's interface as flat tables. Arrays that are null or empty give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_markup

_FILE = "type string, filename string, filepath string, filesize long, mimetype string, fileurl string, timemodified long"
USER = "userid long, username string, fullname string"
ASSIGNMENTS = "struct<courses:array<struct<id:long,assignments:array<struct<id:long,name:string,duedate:long,allowsubmissionsfromdate:long,cutoffdate:long,grade:double>>>>>"
GRADES = "struct<usergrades:array<struct<courseid:long,userid:long,gradeitems:array<struct<id:long,cmid:long,itemname:string,itemtype:string,itemmodule:string,graderaw:double,gradeformatted:string,percentageformatted:string>>>>>"
CALENDAR = "struct<groupedbycourse:array<struct<courseid:long,events:array<struct<id:long,name:string,description:string,eventtype:string,modulename:string,instance:long,timestart:long,timesort:long,timeduration:long,course:struct<id:long>>>>>>"


def _text(c: Column | str, default: str = "") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(default))


def user(df: DataFrame, payload: str = "payload") -> DataFrame:
    p = F.from_json(F.col(payload), USER)
    return df.select(p["userid"].alias("id"), _text(p["username"]).alias("username"), _text(p["fullname"]).alias("fullname"))


def visible(element: Column) -> Column:
    """visible of an object's JSON text: true when the key is absent, false when it is null, 0 or false."""
    absent = ~F.array_contains(F.json_object_keys(element), "visible")
    return absent | F.coalesce(~F.lower(F.get_json_object(element, "$.visible")).isin("0", "false", ""), F.lit(False))


def courses(df: DataFrame, payload: str = "payload") -> DataFrame:
    rows = df.select(F.explode(F.from_json(F.col(payload), "array<string>")).alias("j"))
    c = F.from_json("j", "id long, shortname string, fullname string, category long, progress double, startdate long, enddate long")
    rows = rows.select("j", c.alias("c"))
    return rows.select("c.id", _text("c.shortname").alias("shortname"), _text("c.fullname").alias("fullname"), "c.category", visible(F.col("j")).alias("visible"), "c.progress", "c.startdate", "c.enddate")


def _sections(df: DataFrame, payload: str, course: str) -> DataFrame:
    return df.select(F.col(course).alias("course_id"), F.explode(F.from_json(F.col(payload), "array<string>")).alias("j"))


def sections(df: DataFrame, payload: str = "payload", course: str = "course_id") -> DataFrame:
    """Sections of a course's contents (an array of sections in JSON)."""
    rows = _sections(df, payload, course).select("course_id", "j", F.from_json("j", "id long, section long, name string, summary string").alias("s"))
    return rows.select("s.id", "course_id", F.col("s.section").alias("section_number"), _text("s.name").alias("name"), _text("s.summary").alias("summary"), visible(F.col("j")).alias("visible"))


def _modules(df: DataFrame, payload: str, course: str) -> DataFrame:
    rows = _sections(df, payload, course).select("course_id", F.from_json("j", "id long, modules array<string>").alias("s"))
    return rows.select("course_id", F.col("s.id").alias("section_id"), F.explode("s.modules").alias("j"))


def modules(df: DataFrame, payload: str = "payload", course: str = "course_id") -> DataFrame:
    rows = _modules(df, payload, course).select("course_id", "section_id", "j", F.from_json("j", "id long, modname string, name string, url string").alias("m"))
    return rows.select("m.id", "course_id", "section_id", _text("m.modname").alias("modname"), _text("m.name").alias("name"), "m.url", visible(F.col("j")).alias("visible"))


def files(df: DataFrame, payload: str = "payload", course: str = "course_id") -> DataFrame:
    """Files of modules; entries of other types, or without an address, are none."""
    rows = _modules(df, payload, course).select(F.from_json("j", f"id long, contents array<struct<{', '.join(f.replace(' ', ':') for f in _FILE.split(', '))}>>").alias("m"))
    rows = rows.select(F.col("m.id").alias("module_id"), F.explode("m.contents").alias("f")).filter((F.col("f.type") == "file") & (F.col("f.fileurl") != ""))
    return rows.select("module_id", _text("f.filename").alias("filename"), _text("f.filepath", "/").alias("filepath"), F.coalesce("f.filesize", F.lit(0)).cast("bigint").alias("filesize"), "f.mimetype", "f.fileurl", "f.timemodified")


def assignments(df: DataFrame, payload: str = "payload") -> DataFrame:
    rows = df.select(F.explode(F.from_json(F.col(payload), ASSIGNMENTS)["courses"]).alias("c")).select(F.col("c.id").alias("course_id"), F.explode("c.assignments").alias("a"))
    return rows.select("a.id", "course_id", _text("a.name").alias("name"), "a.duedate", "a.allowsubmissionsfromdate", "a.cutoffdate", "a.grade")


def submission_status(df: DataFrame, payload: str = "payload", assignment: str = "assignment_id") -> DataFrame:
    """All fields of one attempt object: the own submission, or the team's when the own one is absent or empty."""
    last = F.get_json_object(F.col(payload), "$.lastattempt")
    own, team = F.get_json_object(last, "$.submission"), F.get_json_object(last, "$.teamsubmission")
    filled = lambda c: F.coalesce(F.size(F.json_object_keys(c)) > 0, F.lit(False))
    chosen = F.when(filled(own), own).when(filled(team), team)
    return df.select(F.col(assignment).alias("assignment_id"), F.get_json_object(chosen, "$.status").alias("submission_status"), F.get_json_object(last, "$.gradingstatus").alias("grading_status"), F.get_json_object(last, "$.cansubmit").cast("boolean").alias("cansubmit"), F.get_json_object(chosen, "$.timemodified").cast("bigint").alias("submitted_at"))


def grades(df: DataFrame, payload: str = "payload") -> DataFrame:
    rows = df.select(F.explode(F.from_json(F.col(payload), GRADES)["usergrades"]).alias("u")).select(F.col("u.courseid").alias("course_id"), F.col("u.userid").alias("user_id"), F.explode("u.gradeitems").alias("g"))
    return rows.select("g.id", "course_id", "user_id", "g.cmid", F.col("g.itemname").alias("item_name"), F.col("g.itemtype").alias("item_type"), F.col("g.itemmodule").alias("item_module"), F.col("g.graderaw").alias("grade_raw"), F.col("g.gradeformatted").alias("grade_formatted"), F.col("g.percentageformatted").alias("percentage_formatted"))


def calendar(df: DataFrame, payload: str = "payload") -> DataFrame:
    rows = df.select(F.explode(F.from_json(F.col(payload), CALENDAR)["groupedbycourse"]).alias("c")).select(F.explode("c.events").alias("e"))
    return rows.select("e.id", F.col("e.course.id").alias("course_id"), _text("e.name").alias("name"), strip_markup("e.description").alias("description"), _text("e.eventtype").alias("eventtype"), "e.modulename", "e.instance", "e.timestart", "e.timesort", "e.timeduration")


def metadata(c: Column | str) -> Column:
    """Stored JSON metadata as a map; empty for null."""
    return F.from_json(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("{}")), "map<string,string>")
