"""Self-contained HTML reports: a JSON payload and a small canvas script, no libraries."""

from __future__ import annotations

import html
import json
import os

_PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title><style>body{{font:14px sans-serif;margin:2em}}canvas{{border:1px solid #ccc}}</style>
<h1>{title}</h1><canvas id="c" width="1000" height="{height}"></canvas><pre id="t"></pre><script>const d={data};{script}</script>"""
_HEAT = """const g=c.getContext('2d'),w=Math.max(1,980/d.columns.length),h=Math.max(2,(c.height-10)/d.rows.length);
d.cells.forEach((r,i)=>r.forEach((v,j)=>{g.fillStyle=v==null?'#eee':`hsl(${220-220*v},70%,50%)`;g.fillRect(j*w,i*h,w,h)}));t.textContent=d.rows.join('\\n')"""
_LINES = """const g=c.getContext('2d'),xs=d.series.flatMap(s=>s.x),a=Math.min(...xs),b=Math.max(...xs)||1;d.series.forEach((s,k)=>{g.strokeStyle=`hsl(${k*47%360},60%,45%)`;g.beginPath();
s.x.forEach((x,i)=>{const X=(x-a)/(b-a||1)*980+10,Y=c.height-10-s.y[i]*(c.height-20);i?g.lineTo(X,Y):g.moveTo(X,Y)});g.stroke()});t.textContent=d.series.map(s=>s.name).join('\\n')"""
_POINTS = """const g=c.getContext('2d'),m=(k)=>[Math.min(...d.points.map(p=>p[k])),Math.max(...d.points.map(p=>p[k]))],[a,b]=m('x'),[e,f]=m('y');d.points.forEach(p=>{g.fillStyle=p.flag?'#c33':'#36c';
g.beginPath();g.arc((p.x-a)/(b-a||1)*960+20,c.height-20-(p.y-e)/(f-e||1)*(c.height-40),4,0,7);g.fill()});t.textContent=d.points.map(p=>p.name).join('\\n')"""
_KINDS = {"heatmap": _HEAT, "lines": _LINES, "points": _POINTS}


def write_report(path: str, kind: str, title: str, data: dict, height: int = 500) -> None:
    payload = json.dumps(data).replace("</", "<\\/")
    tmp = path + ".tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        f.write(_PAGE.format(title=html.escape(title), height=height, data=payload, script=_KINDS[kind]))
    os.replace(tmp, path)
