"""Fixed schemas of the catalog tables and of the documents read from JSON."""

from __future__ import annotations

CHANNELS = """id string, channel_id string, channel_name string, channel_url string, description string,
category string, priority int, is_active boolean, last_scanned_at timestamp, created_at timestamp,
updated_at timestamp"""

VIDEOS = """id string, video_id string, channel_id string, title string, description string,
published_at timestamp, duration int, tags array<string>, thumbnail_url string, view_count bigint,
is_technical boolean, classification_reason string, classification_confidence double, status string,
transcript_id string, discovered_at timestamp, classified_at timestamp, created_at timestamp,
updated_at timestamp"""

RUNS = """id string, run_type string, channel_id string, videos_discovered int, videos_classified int,
videos_approved int, videos_rejected int, errors array<string>, started_at timestamp,
completed_at timestamp, created_at timestamp"""

TRANSCRIPTS = """id string, title string, loc string, event_date string, speakers array<string>,
tags array<string>, categories array<string>, raw_text string, corrected_text string, summary string,
media_url string, status string, conference string, topics array<string>, channel_name string,
created_at timestamp, updated_at timestamp"""

CATALOG = {"channels": CHANNELS, "videos": VIDEOS, "runs": RUNS, "transcripts": TRANSCRIPTS}

CHAPTER = "struct<idx:string,start:double,title:string>"
PLATFORM = "struct<description:string,tags:array<string>,categories:array<string>,channel_name:string>"

STAGE_STATE = "struct<status:string,completed_at:string,error:string,attempts:int>"
PIPELINE_STATE = f"struct<overall:string,failed_stage:string,stages:map<string,{STAGE_STATE}>>"

VIDEO_ITEM = """id string, snippet struct<title:string,description:string,publishedAt:string,tags:array<string>,
thumbnails:struct<high:struct<url:string>>>, contentDetails struct<duration:string>,
statistics struct<viewCount:string>"""

WORD = "struct<word:string,start:double,end:double,confidence:double,speaker:int,speaker_confidence:double,punctuated_word:string>"
WORD_OUTPUT = (
    "results struct<channels:array<struct<alternatives:array<struct<"
    f"words:array<{WORD}>,summaries:array<struct<summary:string>>>>>>>"
)
UTTERANCE_OUTPUT = """transcription string, utterances array<struct<speaker:string,start:double,`end`:double,text:string>>,
words array<struct<word:string,text:string,start:double,`end`:double,confidence:double>>"""
SEGMENT_OUTPUT = "text string, segments array<struct<start:double,`end`:double,text:string>>"
