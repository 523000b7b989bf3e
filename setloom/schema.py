"""Column types of the play log and of the name dictionaries."""

from __future__ import annotations

PLAY = (
    "event_no int, event_date date, play_order int, dj string, dj_folder string, track_no int, title string, source_work string, "
    "artist string, is_remix boolean, url string, bpm double, year int, note string, source_file_id string, source_file_name string, "
    "source_kind string, confidence string"
)
PLAY_COLUMNS = [c.split()[0] for c in PLAY.split(", ")]
#: A read set list before it is merged: one row a track.
TRACK = "track_no int, title string, source_work string, artist string, is_remix boolean, url string, bpm double, year int, note string, play_order int"
ENTRY = (
    "field string, ord long, id string, canonical string, series string, kind string, variants array<string>, approved boolean, "
    "confidence string, source string, where_ string, decided_at string, reason string"
)
CLUSTER_VALUE = "struct<raw:string,rows:bigint,events:array<int>,djs:array<string>,co_titles:array<string>,co_artists:array<string>,co_works:array<string>,base:string,cross_field:boolean>"
PROPOSAL = "ord long, cluster_id string, canonical string, series string, kind string, variants array<string>, confidence string, reason string"
DECISION = "id string, field string, action string, variants array<string>, canonical string, pairs array<struct<a:string,b:string>>, reason string, where_ string, at string"
EVIDENCE = "map<string,array<struct<source:string,id:string,title:string,kind:string,note:string,url:string>>>"
MANIFEST = (
    "events array<struct<no:int,date:date,folder:string,folder_id:string,djs:array<struct<dj:string,folder:string,folder_id:string,play_order:int,"
    "setlists:array<struct<id:string,name:string,mime:string>>,media_files:array<string>>>>>"
)
