"""Events with standings, and recipes, from nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickerwork.sources.records import parse_lines

EVENT = """TID string, tournamentName string, startDate bigint, topCut int, standings array<struct<id:string,name:string,standing:int,wins:int,
    losses:int,draws:int,decklist:string,deckObj:struct<Commanders:map<string,string>,Mainboard:map<string,string>>>>"""
RECIPE = """id string, status string, uses array<struct<card:struct<oracleId:string>,mustBeCommander:boolean>>, requires array<struct<template:struct<name:string>>>,
    produces array<struct<feature:struct<name:string>>>, manaNeeded string, easyPrerequisites string, notablePrerequisites string, description string"""


def load_events(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """events(event, name, date, size, top_cut), entries(event, pos, leader_text, standing, wins, losses, draws, profile,
    player_name) and entry_items(event, pos, name): only entries with a list, and events with an entry."""
    records = parse_lines(lines, EVENT)
    rows = records.select(F.col("TID").alias("event"), F.posexplode("standings").alias("pos", "_s"))
    leads = F.array_sort(F.map_keys("_s.deckObj.Commanders"))
    listed = rows.filter((F.size(leads) > 0) & (F.size(F.map_keys("_s.deckObj.Mainboard")) > 0))
    zero = lambda c: F.coalesce(F.col(f"_s.{c}"), F.lit(0)).alias(c)
    entries = listed.select("event", "pos", F.array_join(leads, " / ").alias("leader_text"),
                            F.coalesce(F.when(F.col("_s.standing") != 0, F.col("_s.standing")), F.col("pos") + 1).alias("standing"), zero("wins"), zero("losses"), zero("draws"),
                            F.coalesce("_s.id", F.lit("")).alias("profile"), F.trim(F.coalesce("_s.name", F.lit(""))).alias("player_name"))
    items = listed.select("event", "pos", F.explode(F.map_keys("_s.deckObj.Mainboard")).alias("name"))
    events = records.select(F.col("TID").alias("event"), F.trim("tournamentName").alias("name"), F.to_date(F.timestamp_seconds("startDate")).alias("date"),
                            F.size("standings").alias("size"), F.coalesce("topCut", F.lit(0)).alias("top_cut"))
    return events.join(entries.select("event").distinct(), "event", "left_semi"), entries, items


def load_recipes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """recipes(recipe, needs, makes, mana, easy, notable, steps) and recipe_items(recipe, item, must_lead), approved ones only."""
    rows = parse_lines(lines, RECIPE).filter("status = 'OK'")
    recipes = rows.select(F.col("id").alias("recipe"), F.transform("requires", lambda r: r["template"]["name"]).alias("needs"),
                          F.slice(F.transform("produces", lambda p: p["feature"]["name"]), 1, 3).alias("makes"), F.col("manaNeeded").alias("mana"),
                          F.col("easyPrerequisites").alias("easy"), F.col("notablePrerequisites").alias("notable"), F.col("description").alias("steps"))
    items = rows.select(F.col("id").alias("recipe"), F.explode("uses").alias("_u")).groupBy("recipe", F.col("_u.card.oracleId").alias("item")).agg(
        F.bool_or(F.coalesce("_u.mustBeCommander", F.lit(False))).alias("must_lead"))
    return recipes, items
