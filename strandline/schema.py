"""Schemas of the relations that the operators pass on."""

from __future__ import annotations

#: Text fields are never null in messages that a source has read; operators treat null as empty.
MESSAGE = (
    "file_id long, name string, msg_idx int, sender string, timestamp string, recipient string, subject string, attachments array<string>, body string, "
    "message_id string, in_reply_to string, references array<string>"
)
MESSAGE_FIELDS = [x.split()[0] for x in MESSAGE.split(", ")]
EVENT = (
    "id string, date string, title string, category string, badge string, parties string, summary string, importance int, phase string, quote string, significance string, "
    "attachments array<string>, source struct<type:string,label:string,href:string,by:string,at:string>"
)
GROUP = f"id string, label string, category string, events array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ', 1) for x in EVENT.split(', ')))}>>"
TIMELINE = (
    "title string, subtitle string, categories array<struct<id:string,label:string,color:string>>, tabs array<struct<id:string,label:string,heading:string,description:string,"
    f"summary:string,filters:boolean,legend:boolean,categoryFilter:boolean,groups:array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ', 1) for x in GROUP.split(', ', 3)))}>>>>"
)
CLASSIFICATION = "title string, categories array<struct<id:string,label:string>>, assignments array<struct<id:string,category:string,importance:int,summary:string>>"
