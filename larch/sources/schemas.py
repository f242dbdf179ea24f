"""Schemas of the domain's documents, given and never inferred."""

VENDOR_OFFER = "struct<vendor:struct<name:string>,priceRUB:bigint>"
ITEM = (
    "id string, name string, shortName string, basePrice bigint, avg24hPrice bigint, low24hPrice bigint, iconLink string, width int, height int, "
    f"backgroundColor string, gridImageLink string, baseImageLink string, types array<string>, sellFor array<{VENDOR_OFFER}>"
)
_NEED = "struct<id:string,name:string,shortName:string>"
TASK = (
    "id string, name string, minPlayerLevel int, kappaRequired boolean, trader struct<name:string>, "
    f"objectives array<struct<id:string,type:string,count:int,foundInRaid:boolean,item:{_NEED}>>"
)
STATION = f"id string, name string, levels array<struct<id:string,level:int,itemRequirements:array<struct<count:int,item:{_NEED}>>>>"
PROGRESS = "completed_tasks array<string>, completed_hideout array<string>, have map<string,int>"
KEEP_LIST = "categories array<struct<id:string,label:string,items:array<struct<id:string,name:string,aliases:array<string>,acquired:boolean,source:string,tdev_id:string,task:string,count:int>>>>"
ASSOCIATION = "struct<item_id:string,name:string,score:double,mtime:double,preset:boolean,unknown:boolean,W:int,H:int,exact:boolean>"
GATE = "provider string, enabled boolean, agreement double, overlap bigint, coverage double, checked_at double"
RELEASE = "tag_name string, name string, html_url string, assets array<struct<name:string,browser_download_url:string,size:bigint>>"


def struct(ddl: str) -> str:
    """The struct type of a column list."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = ddl[start:i].strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            start = i + 1
    return f"struct<{','.join(out)}>"
