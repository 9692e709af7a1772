"""Schemas of the message log: the columns that operators read; everything else stays in ``raw``."""

from __future__ import annotations

EMBED = "struct<title:string,description:string,author:struct<name:string>,fields:array<struct<name:string,value:string>>,footer:struct<text:string>>"
OVERWRITE = "struct<id:string,type:int,allow:string,deny:string>"

GUILDS = "guild_id bigint, name string, icon string, features array<string>, raw string"
CHANNELS = f"channel_id bigint, guild_id bigint, type int, name string, topic string, position int, parent_id bigint, last_message_id bigint, message_count int, permission_overwrites array<{OVERWRITE}>, raw string"
USERS = "user_id bigint, username string, global_name string, bot boolean, raw string"
ROLES = "role_id bigint, guild_id bigint, name string, color int, permissions decimal(20,0), raw string"
MESSAGES = f"message_id bigint, channel_id bigint, author_id bigint, guild_id bigint, content string, created_at timestamp, type int, mentions array<bigint>, mention_roles array<bigint>, referenced_message_id bigint, embeds array<{EMBED}>, raw string"
ATTACHMENTS = "attachment_id bigint, message_id bigint, filename string, content_type string, size bigint, url string, width int, height int, raw string"
REACTIONS = "message_id bigint, emoji_key string, emoji_id bigint, emoji_name string, count int, raw string"
CHUNKS = "chunk_id bigint, chunk_type string, guild_id bigint, channel_id bigint, message_ids array<bigint>, author_ids array<bigint>, chunk_state string, start_message_id bigint, leaf_message_id bigint, cross_channel_ref bigint, embedding_status string, first_message_at timestamp, last_message_at timestamp"
CHUNK_TEXTS = "chunk_id bigint, text string, token_count int, built_at timestamp"
VECTORS = "chunk_id bigint, guild_id bigint, channel_id bigint, author_ids array<bigint>, first_message_at timestamp, last_message_at timestamp, vector array<float>"

# Payloads of the REST API, as far as the mappers read them. Ids arrive as strings.
API_USER = "struct<id:string,username:string,global_name:string,bot:boolean>"
API_MESSAGE = (
    f"struct<id:string,channel_id:string,guild_id:string,author:{API_USER},content:string,timestamp:string,edited_timestamp:string,type:int,flags:int,pinned:boolean,"
    f"mentions:array<{API_USER}>,mention_roles:array<string>,message_reference:struct<message_id:string,channel_id:string>,webhook_id:string,embeds:array<{EMBED}>,"
    "attachments:array<struct<id:string,filename:string,content_type:string,size:bigint,url:string,width:int,height:int>>,"
    "reactions:array<struct<count:int,emoji:struct<id:string,name:string,animated:boolean>>>>"
)
API_CHANNEL = f"struct<id:string,guild_id:string,type:int,name:string,topic:string,position:int,parent_id:string,last_message_id:string,message_count:int,nsfw:boolean,applied_tags:array<string>,permission_overwrites:array<{OVERWRITE}>>"
API_GUILD = "struct<id:string,name:string,icon:string,owner_id:string,features:array<string>>"
API_ROLE = "struct<id:string,name:string,color:int,position:int,permissions:string>"
API_EMOJI = "struct<id:string,name:string,animated:boolean,available:boolean,roles:array<string>>"
API_STICKER = "struct<id:string,name:string,description:string,format_type:int,available:boolean>"
API_EVENT = "struct<id:string,guild_id:string,channel_id:string,name:string,status:int,scheduled_start_time:string>"
