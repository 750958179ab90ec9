"""Explicit schemas of the file formats; nothing is inferred."""

CORPUS = "text string"
PAGE = "id string, revid string, url string, title string, text string"
DOCUMENT_ITEMS = "id string, sentences array<string>"
SVO = "subj struct<text:string,idx:array<int>>, verb struct<lemma:string,idx:int>, obj struct<text:string,idx:array<int>>"
PARSED = f"sent_id int, raw_sentence string, token_list array<string>, svos array<struct<{SVO.replace(' struct', ':struct')}>>"
GOLD_EN = (
    "tokens array<string>, event_mentions array<struct<event_type:string,trigger:struct<text:string,start:int,end:int>,"
    "arguments:array<struct<entity_id:string,role:string,text:string>>>>, entity_mentions array<struct<id:string,mention_type:string,start:int,end:int>>"
)
GOLD_ZH = "text string, event_list array<struct<event_type:string,trigger:string,arguments:array<struct<role:string,argument:string>>>>"
TRIPLES = "predicate string, subject string, object string, weight double"
RATINGS = "id string, vote string, subjects string, verbs string, objects string"
VECTORS = "word string, vector array<float>"
MATRIX = "row bigint, col bigint, value double"
WIKI_XML = "title string, id bigint, ns int, redirect struct<_title:string>, revision struct<id:bigint,text:string>"
NEWS_XML = "title string, hl1 array<string>, p array<string>"
