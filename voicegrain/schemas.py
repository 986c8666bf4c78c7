"""Schemas of records, units, model answers and stored tables."""

from __future__ import annotations

CFO = """id string, raw_text string, clean_text string, source_channel string,
source_metadata struct<survey_question:string,ticket_category:string,app_store:string,star_rating:int,platform:string>,
user_metadata struct<segment:string,tenure_days:int,geography:string,anonymized_user_id:string>,
timestamps struct<feedback_created:timestamp,ingested_at:timestamp>, language string, extra map<string,string>"""

UNIT_METADATA = """struct<source_channel:string,survey_question:string,star_rating:int,platform:string,
user_segment:string,geography:string,anonymized_uid:string,feedback_created:timestamp>"""

UNITS = "array<struct<text:string,char_start:int,char_end:int>>"

SENTIMENT = """struct<polarity:double,intensity:string,emotions:array<struct<emotion:string,confidence:double>>,
aspect_sentiments:array<struct<aspect:string,polarity:double,evidence:string>>,sarcasm:boolean,confidence:double>"""

INTENT = """struct<intent_type:string,urgency:string,specific_request:string,competitor_mention:string,
churn_indicators:array<struct<signal:string,severity:double>>>"""

COMBINED = f"struct<sentiment:{SENTIMENT},intent:{INTENT}>"

ACCOUNT = "struct<account_name:string,confidence:double,evidence:string>"

TOPICS = """topic_id string, label string, description string, aliases array<string>, feedback_count long,
intent_type string, intent_urgency string, created_at timestamp, updated_at timestamp"""

FEEDBACK_UNITS = f"""unit_id string, parent_cfo_id string, text string, char_start int, char_end int, unit_index int,
is_duplicate boolean, canonical_id string, topic_id string, topic_label string, topic_confidence double, topic_is_new boolean,
metadata {UNIT_METADATA}, raw_extracted_label string, evidence_spans array<string>, specific_request string, competitor_mention string,
churn_indicators array<struct<signal:string,severity:double>>, account_name string, account_method string, account_confidence double,
email_domain string, ungrounded_spans array<string>, is_grounded boolean, errors array<string>, created_at timestamp"""

BATCHES = "batch_id long, total_cfos long, total_units long, canonical_units long, errors long, processing_ms long, created_at timestamp"

UNIT_SENTIMENTS = """unit_id string, polarity double, intensity string, sarcasm_flag boolean, confidence double,
emotions array<struct<emotion:string,confidence:double>>, aspect_sentiments array<struct<aspect:string,polarity:double,evidence:string>>, created_at timestamp"""
