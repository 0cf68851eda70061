"""Schemas of the input document and of the flat tables; nothing is inferred."""

ACCOUNT = "struct<id:string,username:string,accountAgeDays:int,followers:int,following:int,totalPosts:int>"
CONVERSATION = (
    "kind string, post struct<id:string,author:string,text:string,createdAt:timestamp>, "
    f"replies array<struct<id:string,author:{ACCOUNT},text:string,createdAt:timestamp>>"
)
ITEM = "struct<id:string,handle:string,text:string,createdAt:string>"
THREAD_SCAN = f"site string, threadId string, post {ITEM}, replies array<{ITEM}>"
FEED_SCAN = f"site string, items array<{ITEM}>"
