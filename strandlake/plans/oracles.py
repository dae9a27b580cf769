"""The catalogue's queries in plain SQL for DuckDB, written from the definitions, not from the plans."""

from __future__ import annotations

import math

DZ, DY = 1 << 42, 1 << 21
VID = lambda z, y, x: f"(({z})::BIGINT*{DZ}+({y})::BIGINT*{DY}+({x})::BIGINT)"


def _sk(name, spacing):
    return f"""{name} AS MATERIALIZED (SELECT *, {VID('z', 'y', 'x')} AS vid FROM (
 SELECT (seq%4096 + 8192*((user_id//16)//262144))::INTEGER AS z, ({spacing}*((user_id//16)%262144) + event_id%3)::INTEGER AS y,
 ({spacing}*(user_id%16) + ((floor(value)::BIGINT%3)+3)%3 + 256*(seq//4096))::INTEGER AS x, user_id AS fiber, seq, value/500.0::DOUBLE AS intensity
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS seq FROM events)))"""


def _ori(name, sk):
    d = lambda c: f"(coalesce(lead({c}) OVER w,{c})-coalesce(lag({c}) OVER w,{c}))"
    return f"""{name} AS MATERIALIZED (SELECT vid,z,y,x,fiber,seq,intensity, a/n AS oz, b/n AS oy, c/n AS ox FROM (SELECT *,
 CASE WHEN sqrt((a*a+b*b+c*c)::DOUBLE)<1e-8 THEN 1.0 ELSE sqrt((a*a+b*b+c*c)::DOUBLE) END AS n FROM (
 SELECT *, {d('z')} AS a, {d('y')} AS b, {d('x')} AS c FROM {sk} WINDOW w AS (PARTITION BY fiber ORDER BY seq))))"""


OFF = f"""off AS MATERIALIZED (SELECT dz,dy,dx,dz*{DZ}+dy*{DY}+dx AS d FROM (SELECT range AS dz FROM range(-1,2)), (SELECT range AS dy FROM range(-1,2)), (SELECT range AS dx FROM range(-1,2)))"""
BALL = f"""ball AS MATERIALIZED (SELECT * FROM off WHERE dz*dz+dy*dy+dx*dx<=1)"""


def _nb(name, t):
    """Neighbour pairs (a, b), a <> b."""
    return f"{name} AS MATERIALIZED (SELECT s.vid AS a, n.vid AS b FROM {t} s CROSS JOIN off JOIN {t} n ON n.vid=s.vid+off.d WHERE off.d<>0)"


def _deg(name, t):
    return f"{name} AS MATERIALIZED (SELECT vid,z,y,x,(SELECT count(*) FROM off JOIN {t} n ON n.vid=s.vid+off.d WHERE off.d<>0)::INTEGER AS deg FROM {t} s)"


def _deg2(name, t):
    return f"""{name} AS MATERIALIZED (SELECT s.vid,any_value(s.z) AS z,any_value(s.y) AS y,any_value(s.x) AS x,(count(n.vid)-1)::INTEGER AS deg
 FROM {t} s CROSS JOIN off LEFT JOIN {t} n ON n.vid=s.vid+off.d GROUP BY s.vid)"""


def _fg(name, sk, extra=""):
    """Ball of radius 1; extra: aggregates over the source rows (alias s)."""
    return f"""{name} AS MATERIALIZED (SELECT {VID('z', 'y', 'x')} AS vid,z,y,x{',' if extra else ''}{extra} FROM (
 SELECT (s.z+dz)::INTEGER AS z,(s.y+dy)::INTEGER AS y,(s.x+dx)::INTEGER AS x, s.* EXCLUDE (z,y,x,vid) FROM {sk} s CROSS JOIN ball) s
 WHERE z>=0 AND y>=0 AND x>=0 GROUP BY z,y,x)"""


def _cc(name, t, e):
    return f"""{name}(v,l) USING KEY (v) AS (SELECT vid, vid FROM {t} UNION
 SELECT e.b, min(c.l) FROM {name} c JOIN {e} e ON e.a=c.v JOIN recurring.{name} r ON r.v=e.b WHERE c.l<r.l GROUP BY e.b)"""


def sql(body, *ctes):
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


SK, SK8 = _sk("sk", 3), _sk("sk8", 8)
D3 = _deg2("deg", "sk")
JUNC = "junc AS MATERIALIZED (SELECT vid,z,y,x FROM deg WHERE deg>=3)"
REST = "rest AS MATERIALIZED (SELECT vid,z,y,x FROM deg WHERE deg<3)"
BASE = (SK, OFF, D3, JUNC, REST)
FG = (SK, OFF, BALL, _fg("fg", "sk"))
FGL = (SK, OFF, BALL, _fg("fg", "sk", "(min(fiber)+1)::INTEGER AS label"))
FG8 = (SK8, OFF, BALL, _fg("fg", "sk8"))
SIX = "abs(dz)+abs(dy)+abs(dx)=1"
O: dict[str, str] = {}

O["voxel_degree"] = sql("SELECT vid,z,y,x,deg FROM deg", SK, OFF, D3)
O["voxel_classes"] = sql("SELECT CASE deg WHEN 0 THEN 'isolated' WHEN 1 THEN 'end' WHEN 2 THEN 'path' ELSE 'junction' END AS cls, count(*) AS n FROM deg GROUP BY 1", SK, OFF, D3)
O["junction_voxels"] = sql("SELECT vid,z,y,x FROM junc", *BASE)
O["mask_difference"] = sql("SELECT vid,z,y,x FROM rest", *BASE)
O["endpoint_voxels"] = sql("SELECT vid,z,y,x FROM d2 WHERE deg=1", *BASE, _deg2("d2", "rest"))
O["prune_spurs"] = sql("SELECT vid,z,y,x FROM d2 WHERE deg<>1", SK, OFF, D3, "p1 AS MATERIALIZED (SELECT vid,z,y,x FROM deg WHERE deg<>1)", _deg2("d2", "p1"))
O["ball_dilate"] = sql("SELECT vid,z,y,x FROM fg", *FG)
O["border_shell"] = sql(f"SELECT f.vid,any_value(f.z) AS z,any_value(f.y) AS y,any_value(f.x) AS x FROM fg f CROSS JOIN off LEFT JOIN fg n ON n.vid=f.vid+off.d WHERE {SIX} GROUP BY f.vid HAVING count(n.vid)<6", *FG)
O["border_shell_labelled"] = sql(f"SELECT f.vid,any_value(f.z) AS z,any_value(f.y) AS y,any_value(f.x) AS x,f.label FROM fg f CROSS JOIN off LEFT JOIN fg n ON n.vid=f.vid+off.d AND n.label=f.label WHERE {SIX} GROUP BY f.vid,f.label HAVING count(n.vid)<6", *FGL)
O["shell_points"] = sql(f"""SELECT h.z,h.y,h.x,coalesce(s.fiber+1,0)::INTEGER AS label FROM (SELECT f.vid,any_value(f.z) AS z,any_value(f.y) AS y,any_value(f.x) AS x FROM fg f
 CROSS JOIN off LEFT JOIN fg n ON n.vid=f.vid+off.d WHERE {SIX} GROUP BY f.vid HAVING count(n.vid)<6) h LEFT JOIN sk s USING (vid)""", *FG)
O["six_faces"] = sql(" UNION ALL ".join(f"SELECT vid,'{c}_{m}' AS face FROM sk WHERE {c}={'0' if m == 'min' else f'(SELECT max({c}) FROM sk)'}" for c in "zyx" for m in ("min", "max")), SK)
O["border_crop"] = sql(f"""SELECT {VID('z', 'y', 'x')} AS vid,z,y,x,fiber FROM (SELECT z-2 AS z,y-2 AS y,x-2 AS x,fiber FROM sk WHERE
 {' AND '.join(f'{c}>=2 AND {c}<=(SELECT max({c}) FROM sk)-2' for c in 'zyx')})""", SK)
O["sub_box"] = sql("SELECT vid,z,y,x FROM sk WHERE z BETWEEN 10 AND 40 AND y BETWEEN 0 AND 20 AND x BETWEEN 5 AND 30", SK)
O["face_of_point"] = sql("""SELECT vid, CASE WHEN z<=1 THEN 'z_min' WHEN z>=46 THEN 'z_max' WHEN y<=1 THEN 'y_min' WHEN y>=46 THEN 'y_max'
 WHEN x<=1 THEN 'x_min' WHEN x>=46 THEN 'x_max' ELSE 'internal' END AS face FROM sk""", SK)
O["threshold_core"] = sql("SELECT vid,z,y,x,intensity FROM sk WHERE intensity>=0.28", SK)
O["fg_union"] = sql("SELECT vid,z,y,x FROM sk WHERE seq%3=0 OR intensity>=0.10 UNION SELECT vid,z,y,x FROM junc", *BASE)
O["mask_intersection"] = sql("SELECT f.vid,f.z,f.y,f.x FROM fg f SEMI JOIN (SELECT vid FROM sk WHERE intensity>=0.28) s USING (vid)", *FG)
_mx = ",".join(f"(SELECT max({c}) FROM fg) AS n{c}" for c in "zyx")
O["median3"] = sql(f"""SELECT {VID('z', 'y', 'x')} AS vid,z,y,x FROM (SELECT (f.z+dz)::INTEGER AS z,(f.y+dy)::INTEGER AS y,(f.x+dx)::INTEGER AS x FROM fx f CROSS JOIN off) t, m
 WHERE z BETWEEN 0 AND nz AND y BETWEEN 0 AND ny AND x BETWEEN 0 AND nx GROUP BY z,y,x HAVING count(*)>=14""", *FG, f"m AS (SELECT {_mx})",
               *[f"{b} AS MATERIALIZED (SELECT * FROM {a} UNION ALL SELECT * REPLACE (-1 AS {c}) FROM {a} WHERE {c}=0 UNION ALL SELECT * REPLACE ((SELECT n{c}+1 FROM m) AS {c}) FROM {a} WHERE {c}=(SELECT n{c} FROM m))"
                 for a, b, c in (("fg", "f1", "z"), ("f1", "f2", "y"), ("f2", "fx", "x"))])


def _gauss(sigma):
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return r, [v / sum(w) for v in w]


def _gauss_pass(a, b, c, sigma):
    r, w = _gauss(sigma)
    other = [k for k in "zyx" if k != c]
    vals = ",".join(f"({k - r},{w[k]!r}::DOUBLE)" for k in range(2 * r + 1))
    return f"""{b} AS MATERIALIZED (SELECT {c}, {','.join(other)}, sum(v) AS v FROM (SELECT ({c}+o.d)::INTEGER AS {c},{','.join(other)},v*o.w AS v FROM (
 SELECT * FROM {a} UNION ALL SELECT * REPLACE (-1-{c} AS {c}) FROM {a} WHERE {c}<{r} UNION ALL SELECT * REPLACE ((2*(SELECT n{c} FROM m)-1-{c})::INTEGER AS {c}) FROM {a} WHERE {c}>=(SELECT n{c} FROM m)-{r}), (VALUES {vals}) o(d,w))
 WHERE {c}>=0 AND {c}<(SELECT n{c} FROM m) GROUP BY z,y,x)"""


_M = "m AS (SELECT " + ",".join(f"max({c})+1 AS n{c}" for c in "zyx") + " FROM sk)"
O["gaussian3d"] = sql(f"SELECT {VID('z', 'y', 'x')} AS vid,z,y,x,round(v,6) AS intensity FROM g3", SK, _M, "g0 AS (SELECT z,y,x,intensity AS v FROM sk)",
                      _gauss_pass("g0", "g1", "z", 0.6), _gauss_pass("g1", "g2", "y", 0.6), _gauss_pass("g2", "g3", "x", 0.6))
O["tile_density"] = sql("SELECT (z//16)::INTEGER AS tz,(y//16)::INTEGER AS ty,(x//16)::INTEGER AS tx,round(count(*)/4096.0::DOUBLE,9) AS density,max(intensity) AS max_intensity FROM sk GROUP BY 1,2,3", SK)


def _starts(c, size=32, ov=16):
    """Chunk starts along an axis, with their index."""
    n, step = f"(SELECT n{c} FROM m)", size - ov
    return f"""st{c} AS MATERIALIZED (SELECT s AS {c}0, least(s+{size},{n})::INTEGER AS {c}1, row_number() OVER (ORDER BY s)-1 AS i{c}, count(*) OVER () AS k{c} FROM (
 SELECT range::INTEGER AS s FROM range(0,greatest(1,{n}-{ov}),{step})
 UNION SELECT (CASE WHEN {n}>={size} THEN {n}-{size} ELSE 0 END)::INTEGER FROM (SELECT max(range) AS q FROM range(0,greatest(1,{n}-{ov}),{step})) WHERE q+{size}<{n}))"""


CH = (_M, _starts("z"), _starts("y"), _starts("x"),
      "grid AS MATERIALIZED (SELECT ((iz*ky+iy)*kx+ix)::BIGINT AS chunk,z0,z1,y0,y1,x0,x1 FROM stz,sty,stx)")
_IN = lambda v, g: " AND ".join(f"{v}.{c}>={g}.{c}0 AND {v}.{c}<{g}.{c}1" for c in "zyx")
ASSIGN = f"asg AS MATERIALIZED (SELECT g.chunk,s.* FROM sk s JOIN grid g ON {_IN('s', 'g')})"
O["active_chunks"] = sql("SELECT chunk,max(intensity) AS max_intensity FROM asg GROUP BY 1 HAVING max(intensity)>=0.28", SK, *CH, ASSIGN)
O["dense_patch"] = sql(f"""SELECT c.id,c.z0,c.y0,c.x0,count(s.vid)/512.0::DOUBLE AS density FROM (SELECT id,
 {','.join(f'CASE WHEN id=50 THEN greatest(n{c}-8,0)//2 ELSE floor(((id*{k}+{k})%997)/997.0::DOUBLE*(greatest(n{c}-8,0)+1)) END::INTEGER AS {c}0' for c, k in zip('zyx', (379, 521, 761)))} FROM (SELECT range AS id FROM range(51)), m) c
 LEFT JOIN sk s ON {' AND '.join(f's.{c}>=c.{c}0 AND s.{c}<c.{c}0+8' for c in 'zyx')} GROUP BY 1,2,3,4 HAVING id=50 OR density BETWEEN 0.03 AND 0.35 ORDER BY id LIMIT 1""", SK, _M)
O["mip"] = sql("SELECT y,x,max(intensity) AS v FROM sk GROUP BY 1,2", SK)
O["intensity_u16"] = sql("SELECT vid,trunc(least(greatest(intensity*1.5::DOUBLE-0.1::DOUBLE,0),1)*65535)::INTEGER AS v FROM sk", SK)
O["orientation_rgb"] = sql("SELECT vid," + ",".join(f"trunc(least(abs(o{c}),1)*255)::INTEGER AS {c}" for c in "zyx") + " FROM ori", SK, _ori("ori", "sk"))

# components
E_REST, E_JUNC = _nb("er", "rest"), _nb("ej", "junc")
CC_R, CC_J = _cc("ccr", "rest", "er"), _cc("ccj", "junc", "ej")
O["branch_components"] = sql("SELECT v AS vid,l AS comp FROM ccr", *BASE, E_REST, CC_R)
O["junction_clusters"] = sql("SELECT v AS vid,l AS comp FROM ccj", *BASE, E_JUNC, CC_J)
# Consecutive balls of a fibre always touch, so its voxels are one piece: contract fibres, then join them.
def _fgcc(sk):
    return (f"ow AS MATERIALIZED (SELECT DISTINCT f.vid,s.fiber FROM {sk} s CROSS JOIN ball JOIN fg f ON f.vid=s.vid+ball.d)",
            "mo AS MATERIALIZED (SELECT vid,min(fiber) AS fiber FROM ow GROUP BY 1)",
            "mt0 AS MATERIALIZED (SELECT a.fiber,a.vid+off.d AS t FROM mo a CROSS JOIN off)",
            "mt1 AS MATERIALIZED (SELECT m.fiber AS a,b.fiber AS b FROM mt0 m JOIN mo b ON b.vid=m.t)",
            "ff AS MATERIALIZED (SELECT DISTINCT a,b FROM mt1 WHERE a<>b UNION SELECT DISTINCT a.fiber,b.fiber FROM ow a JOIN ow b USING (vid) WHERE a.fiber<>b.fiber)",
            f"fn AS MATERIALIZED (SELECT DISTINCT fiber AS vid FROM {sk})", _cc("cw", "fn", "ff"),
            "ccf AS MATERIALIZED (SELECT o.vid AS v,min(o.vid) OVER (PARTITION BY c.l) AS l FROM mo o JOIN cw c ON c.v=o.fiber)")


O["fg_components"] = sql("SELECT l AS comp,count(*) AS n FROM ccf GROUP BY 1", *FG, *_fgcc("sk"))
O["label_components"] = sql("SELECT c.v AS vid,(s.fiber+1)::INTEGER AS label,c.l AS comp FROM ccl c JOIN sk s ON s.vid=c.v", SK, OFF,
                            "el AS MATERIALIZED (SELECT s.vid AS a,n.vid AS b FROM sk s CROSS JOIN off JOIN sk n ON n.vid=s.vid+off.d AND n.fiber=s.fiber WHERE off.d<>0)", _cc("ccl", "sk", "el"))
CC8 = (*FG8, *_fgcc("sk8"), "cf AS MATERIALIZED (SELECT f.*,c.l AS comp FROM fg f JOIN ccf c ON c.v=f.vid)")
_BOX = ",".join(f"min({c}) AS {c}0,max({c}) AS {c}1" for c in "zyx")
O["component_bbox"] = sql(f"SELECT comp,count(*) AS n,{_BOX} FROM cf GROUP BY comp", *CC8)
O["component_label_class"] = sql(f"""SELECT b.comp,b.n,((z1-z0+1)::BIGINT*(y1-y0+1)*(x1-x0+1))::BIGINT AS box,
 CASE WHEN k IS NULL THEN 'unseeded' WHEN k=1 THEN 'single' ELSE 'multi' END AS cls FROM (SELECT comp,count(*) AS n,{_BOX} FROM cf GROUP BY comp) b
 LEFT JOIN (SELECT comp,count(DISTINCT seq//20) AS k FROM cf JOIN sk8 USING (vid) WHERE fiber%5<>0 GROUP BY comp) s USING (comp)""", *CC8)

# branches and severing
Z = lambda v: f"({v}>>42)"
Y = lambda v: f"(({v}>>21)&{DY - 1})"
X = lambda v: f"({v}&{DY - 1})"
FX = lambda e: f"round_even(({e})*1000000000.0::DOUBLE,0)::BIGINT"
ORI = _ori("ori", "sk")
BR = (*BASE, E_REST, CC_R, E_JUNC, CC_J, "br AS MATERIALIZED (SELECT v AS vid,l AS branch FROM ccr)", "cl AS MATERIALIZED (SELECT v AS vid,l AS cluster FROM ccj)")
ST0 = "st0 AS MATERIALIZED (SELECT b.branch,count(*) AS n,min(vid) AS first_vid,max(vid) AS last_vid," + ",".join(
    f"(sum({FX('o' + c)})::BIGINT)::DOUBLE/1000000000.0::DOUBLE/count(*) AS a{c}" for c in "zyx") + " FROM br b JOIN ori USING (vid) GROUP BY 1)"
ST1 = "st1 AS MATERIALIZED (SELECT *,CASE WHEN sqrt(az*az+ay*ay+ax*ax)<1e-8 THEN 1.0 ELSE sqrt(az*az+ay*ay+ax*ax) END AS nn FROM st0)"
ST = "st AS MATERIALIZED (SELECT branch,n,first_vid,last_vid,az/nn AS mz,ay/nn AS my,ax/nn AS mx," + ",".join(
    f"({g('last_vid')}-{g('first_vid')})::INTEGER AS {c}" for g, c in ((Z, "cz"), (Y, "cy"), (X, "cx"))) + " FROM st1)"
TOUCH = "tch AS MATERIALIZED (SELECT DISTINCT b.branch,c.cluster FROM br b CROSS JOIN off JOIN cl c ON c.vid=b.vid+off.d)"
STATS = (*BR, ORI, ST0, ST1, ST)
O["branch_stats"] = sql("SELECT branch,n,first_vid,last_vid,round(mz,6) AS mz,round(my,6) AS my,round(mx,6) AS mx FROM st", *STATS)
O["branch_chord"] = sql("SELECT branch,n,cz,cy,cx,round(sqrt((cz*cz+cy*cy+cx*cx)::DOUBLE),6) AS chord FROM st", *STATS)
O["branch_touch"] = sql("SELECT branch,cluster FROM tch", *BR, TOUCH)
ADJ = "adj AS MATERIALIZED (SELECT DISTINCT a.branch AS i,b.branch AS j FROM tch a JOIN tch b ON a.cluster=b.cluster AND a.branch<>b.branch)"
O["branch_adjacency"] = sql("SELECT t.branch,(SELECT count(*) FROM adj WHERE i=t.branch) AS n_adjacent FROM (SELECT DISTINCT branch FROM tch) t", *BR, TOUCH, ADJ)
RUNG = (*STATS, TOUCH, ADJ,
        "lg AS MATERIALIZED (SELECT a.i,b.branch AS j,mz,my,mx FROM adj a JOIN st b ON b.branch=a.j WHERE b.n>=8)",
        "rf AS MATERIALIZED (SELECT i,min(j) AS f FROM lg GROUP BY 1)",
        "tr0 AS MATERIALIZED (SELECT l.i,count(*) AS k," + ",".join(f"sum({FX(f'CASE WHEN l.mz*f.mz+l.my*f.my+l.mx*f.mx<0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END*l.m{c}')})::BIGINT::DOUBLE/1000000000.0::DOUBLE/count(*) AS t{c}" for c in "zyx")
        + " FROM lg l JOIN rf r USING (i) JOIN st f ON f.branch=r.f GROUP BY 1)",
        "tr AS MATERIALIZED (SELECT *,sqrt(tz*tz+ty*ty+tx*tx) AS tn FROM tr0)",
        "nc AS MATERIALIZED (SELECT branch,count(*) AS k FROM tch GROUP BY 1)",
        "sh AS MATERIALIZED (SELECT s.*,coalesce(nc.k,0) AS nclu,sqrt((cz*cz+cy*cy+cx*cx)::DOUBLE) AS chord,sqrt(mz*mz+my*my+mx*mx)>1e-8 AS has FROM st s LEFT JOIN nc USING (branch) WHERE n<=6)",
        """sv AS MATERIALIZED (SELECT branch,n::INTEGER AS n,CASE WHEN chord<1 THEN CASE WHEN nclu>=1 THEN 'tiny' END
 WHEN nclu>=2 AND abs(cz/chord*CASE WHEN has THEN mz ELSE 1.0 END+cy/chord*CASE WHEN has THEN my ELSE 0.0 END+cx/chord*CASE WHEN has THEN mx ELSE 0.0 END)<0.60 THEN 'misaligned'
 WHEN tn>1e-8 AND 1.0-abs(cz/chord*(tz/tn)+cy/chord*(ty/tn)+cx/chord*(tx/tn))>0.5 THEN 'perpendicular' END AS rule FROM sh LEFT JOIN tr ON tr.i=sh.branch)""")
O["rung_severed"] = sql("SELECT * FROM sv WHERE rule IS NOT NULL", *RUNG)
O["severed_skeleton"] = sql("SELECT r.vid,r.z,r.y,r.x FROM rest r JOIN br USING (vid) ANTI JOIN (SELECT branch FROM sv WHERE rule IS NOT NULL) g USING (branch) UNION ALL SELECT vid,z,y,x FROM junc", *RUNG)

# fragments
O["fragment_lengths"] = sql("SELECT branch AS frag,count(*) AS n FROM br GROUP BY 1", *BASE, E_REST, CC_R, "br AS MATERIALIZED (SELECT v AS vid,l AS branch FROM ccr)")
O["long_fragments"] = sql("SELECT vid,branch AS frag FROM br WHERE branch IN (SELECT branch FROM br GROUP BY 1 HAVING count(*)>=5)", *BASE, E_REST, CC_R, "br AS MATERIALIZED (SELECT v AS vid,l AS branch FROM ccr)")


def _frags(sk):
    return (_sk(sk, 3 if sk == "sk" else 8), OFF, _deg2("deg", sk), JUNC, REST, E_REST, CC_R, _deg2("dr", "rest"),
            "fv AS MATERIALIZED (SELECT d.vid,d.z,d.y,d.x,c.l AS frag,d.deg FROM dr d JOIN ccr c ON c.v=d.vid)",
            "fe AS MATERIALIZED (SELECT frag,count(*)::INTEGER AS length,min(CASE WHEN deg<=1 THEN vid END) AS head,max(CASE WHEN deg<=1 THEN vid END) AS tail FROM fv GROUP BY 1)",
            f"et AS MATERIALIZED (SELECT frag,u.e AS \"end\",length AS n,vid,{Z('vid')}::INTEGER AS z,{Y('vid')}::INTEGER AS y,{X('vid')}::INTEGER AS x FROM (SELECT frag,length,0::INTEGER AS e,head AS vid FROM fe UNION ALL SELECT frag,length,1::INTEGER,tail FROM fe) u)")


# closed loops: two breadth-first sweeps, ties to the smaller id
_SWEEP = lambda name, seed: f"""{name}(v,h) USING KEY (v) AS (SELECT {seed} UNION SELECT e.b, min(c.h+1) FROM {name} c JOIN le e ON e.a=c.v LEFT JOIN recurring.{name} r ON r.v=e.b WHERE r.h IS NULL OR c.h+1<r.h GROUP BY e.b)"""
LOOPS = ("lf AS MATERIALIZED (SELECT frag FROM fe WHERE head IS NULL)",
         "le AS MATERIALIZED (SELECT a,b FROM er JOIN fv ON fv.vid=er.a WHERE fv.frag IN (SELECT frag FROM lf))",
         _SWEEP("w1", "frag,0 FROM lf"),
         "p1 AS MATERIALIZED (SELECT frag,arg_min(v,(-h,v)) AS head FROM w1 JOIN fv ON fv.vid=w1.v GROUP BY frag)",
         _SWEEP("w2", "head,0 FROM p1"),
         "p2 AS MATERIALIZED (SELECT frag,arg_min(v,(-h,v)) AS tail FROM w2 JOIN fv ON fv.vid=w2.v GROUP BY frag)",
         "fl AS MATERIALIZED (SELECT fe.frag,fe.length,coalesce(fe.head,p1.head) AS head,coalesce(fe.tail,p2.tail) AS tail FROM fe LEFT JOIN p1 USING (frag) LEFT JOIN p2 USING (frag))")
O["fragment_endpoints"] = sql("SELECT frag,length,head,tail FROM fl", *_frags("sk"), *LOOPS)
_WALK = """wk(v,h) USING KEY (v) AS (SELECT head,0::BIGINT FROM fe UNION SELECT e.b,min(c.h+1) FROM wk c JOIN er e ON e.a=c.v LEFT JOIN recurring.wk r ON r.v=e.b WHERE r.h IS NULL OR c.h+1<r.h GROUP BY e.b)"""
O["fragment_path_order"] = sql("SELECT fv.frag,v AS vid,h AS seq FROM wk JOIN fv ON fv.vid=wk.v", *_frags("sk8"), _WALK)
_ETL = f"et AS MATERIALIZED (SELECT frag,u.e AS \"end\",length AS n,vid,{Z('vid')}::INTEGER AS z,{Y('vid')}::INTEGER AS y,{X('vid')}::INTEGER AS x FROM (SELECT frag,length,0::INTEGER AS e,head AS vid FROM fl UNION ALL SELECT frag,length,1::INTEGER,tail FROM fl) u)"
ANCH = """an AS MATERIALIZED (SELECT * FROM (SELECT e.frag,e."end",e.n,v.vid AS avid,v.z AS az,v.y AS ay,v.x AS ax,row_number() OVER (PARTITION BY e.frag,e."end" ORDER BY (v.z-e.z)**2+(v.y-e.y)**2+(v.x-e.x)**2,v.vid) AS r
 FROM et e JOIN fv v ON v.frag=e.frag) WHERE r=least(6,n))"""
_u = "CASE WHEN sqrt(oz*oz+oy*oy+ox*ox)<1e-8 THEN 1.0 ELSE sqrt(oz*oz+oy*oy+ox*ox) END"
TEN = ",".join(f"round((coalesce(sum({FX(f'u{a}*u{b}')}),0)::BIGINT)::DOUBLE/1000000000.0::DOUBLE,6)+0.0::DOUBLE AS t{a}{b}" for a, b in ("zz", "zy", "zx", "yy", "yx", "xx"))
O["nematic_tensor"] = sql(f"""SELECT a.frag,a."end",a.avid,{TEN} FROM an a LEFT JOIN (SELECT *,oz/({_u}) AS uz,oy/({_u}) AS uy,ox/({_u}) AS ux,cz,cy,cx FROM ori, (SELECT range AS cz FROM range(-2,3)), (SELECT range AS cy FROM range(-2,3)), (SELECT range AS cx FROM range(-2,3))) f
 ON f.vid+f.cz*{DZ}+f.cy*{DY}+f.cx=a.avid GROUP BY 1,2,3""", *[c for c in _frags("sk") if not c.startswith("et ")], *LOOPS, _ETL, ANCH, ORI)

# pairs of ends and bridges
FE8 = (*_frags("sk8"), *LOOPS, _ETL.replace("et AS", "etl AS"))
_CELL = lambda c, s: f"{c}//{s}"


def _pairs(name, t, cols, r, extra=""):
    """Pairs within r by an equi-join on cells of side r: the neighbour cells of the left side are listed."""
    k = ",".join(f"floor({c}/{float(r)})::BIGINT AS c{i}" for i, c in enumerate("zyx"))
    return (f"{name}c AS MATERIALIZED (SELECT *,{k} FROM {t})",
            f"{name}n AS MATERIALIZED (SELECT p.*,c0+dz AS e0,c1+dy AS e1,c2+dx AS e2 FROM {name}c p, off)",
            f"{name} AS MATERIALIZED (SELECT {cols},(a.z-b.z)**2+(a.y-b.y)**2+(a.x-b.x)**2 AS d2 FROM {name}n a JOIN {name}c b ON a.e0=b.c0 AND a.e1=b.c1 AND a.e2=b.c2 WHERE (a.z-b.z)**2+(a.y-b.y)**2+(a.x-b.x)**2<={float(r * r)} {extra})")


_PC = 'a.frag AS frag_a,a."end" AS end_a,b.frag AS frag_b,b."end" AS end_b'
_AFTER = 'AND a.frag<b.frag'
O["endpoint_pairs"] = sql("SELECT frag_a,end_a,frag_b,end_b,d2::INTEGER AS d2 FROM pr", *FE8, *_pairs("pr", "etl", _PC, 4, _AFTER))
ORI8 = _ori("ori", "sk8")
# end directions: closed-form eigenvector of the fixed-point tensor
_E6 = ("zz", "zy", "zx", "yy", "yx", "xx")
_M3 = [["zz", "zy", "zx"], ["zy", "yy", "yx"], ["zx", "yx", "xx"]]
_SH = [[f"(m{n}-l)" if i == j else f"m{n}" for j, n in enumerate(row)] for i, row in enumerate(_M3)]
_X3 = lambda a, b: [f"({a[1]}*{b[2]}-{a[2]}*{b[1]})", f"({a[2]}*{b[0]}-{a[0]}*{b[2]})", f"({a[0]}*{b[1]}-{a[1]}*{b[0]})"]
_D3 = lambda a, b: "(" + "+".join(f"{p}*{q}" for p, q in zip(a, b)) + ")"


def _vector(name, src):
    """Longest cross product of two rows of the shifted matrix, its squared length and the unit vector."""
    xs = [_X3(_SH[i], _SH[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    cols = ",".join(f"{xs[k][c]} AS x{k}{c}" for k in range(3) for c in range(3))
    pick = ",".join(f"CASE WHEN s0>=s1 AND s0>=s2 THEN x0{c} WHEN s1>=s2 THEN x1{c} ELSE x2{c} END AS v{c}" for c in range(3))
    return (f"{name}a AS (SELECT *,{cols} FROM {src})", f"{name}b AS (SELECT *,{','.join(f'x{k}0*x{k}0+x{k}1*x{k}1+x{k}2*x{k}2 AS s{k}' for k in range(3))} FROM {name}a)",
            f"{name}c AS (SELECT * EXCLUDE (x00,x01,x02,x10,x11,x12,x20,x21,x22,s0,s1,s2),{pick},greatest(s0,s1,s2) AS s,greatest(s0,s1,s2)>1e-12*p2*p2 AS good FROM {name}b)",
            f"{name} AS (SELECT *," + ",".join(f"v{c}/sqrt(CASE WHEN good THEN s ELSE 1.0 END) AS w{c}" for c in range(3)) + f" FROM {name}c)")


_DG = [f"(m{n}-q)" for n in ("zz", "yy", "xx")]
_BIG = lambda c: f"CASE WHEN n0>=n1 AND n0>=n2 THEN {_SH[0][c]} WHEN n1>=n2 THEN {_SH[1][c]} ELSE {_SH[2][c]} END"
_RAW = ",".join(f"(coalesce(sum({FX(f'u{a}*u{b}')}),0)::BIGINT)::DOUBLE/1000000000.0::DOUBLE AS m{a}{b}" for a, b in _E6)
EIGEN = (
    f"""te AS MATERIALIZED (SELECT a.frag,a."end",any_value(a.avid) AS avid,any_value(a.az) AS az,any_value(a.ay) AS ay,any_value(a.ax) AS ax,{_RAW} FROM an a LEFT JOIN (SELECT *,oz/({_u}) AS uz,oy/({_u}) AS uy,ox/({_u}) AS ux,cz,cy,cx FROM ori, (SELECT range AS cz FROM range(-2,3)), (SELECT range AS cy FROM range(-2,3)), (SELECT range AS cx FROM range(-2,3))) f
 ON f.vid+f.cz*{DZ}+f.cy*{DY}+f.cx=a.avid GROUP BY 1,2)""",
    "e1 AS (SELECT *,(mzz+myy+mxx)/3.0::DOUBLE AS q FROM te)",
    f"e2 AS (SELECT *,{'+'.join(f'{d}*{d}' for d in _DG)}+2.0*(mzy*mzy+mzx*mzx+myx*myx) AS p2 FROM e1)", "e3 AS (SELECT *,sqrt(p2/6.0) AS p FROM e2)",
    f"""e4 AS MATERIALIZED (SELECT *,CASE WHEN p>1e-9 THEN q+2.0*p*cos(acos(least(greatest(({_DG[0]}*({_DG[1]}*{_DG[2]}-myx*myx)-mzy*(mzy*{_DG[2]}-myx*mzx)+mzx*(mzy*myx-{_DG[1]}*mzx))/CASE WHEN p>1e-9 THEN 2.0*p*p*p ELSE 1.0 END,-1.0),1.0))/3.0) ELSE q END AS l FROM e3)""",
    *_vector("f1", "e4"),
    "f2 AS MATERIALIZED (SELECT * EXCLUDE (v0,v1,v2,s,good,w0,w1,w2,l),CASE WHEN good THEN w0*(mzz*w0+mzy*w1+mzx*w2)+w1*(mzy*w0+myy*w1+myx*w2)+w2*(mzx*w0+myx*w1+mxx*w2) ELSE l END AS l FROM f1)",
    *_vector("f3", "f2"),
    f"f4 AS (SELECT *,{','.join(f'{_D3(_SH[k], _SH[k])} AS n{k}' for k in range(3))} FROM f3)", f"f5 AS (SELECT *,{_BIG(0)} AS b0,{_BIG(1)} AS b1 FROM f4)",
    "f6 AS (SELECT *,sqrt(b0*b0+b1*b1) AS pn FROM f5)",
    "f7 AS (SELECT *,CASE WHEN good THEN w0 WHEN pn<=1e-6*p THEN 1.0 ELSE b1/pn END AS g0,CASE WHEN good THEN w1 WHEN pn<=1e-6*p THEN 0.0 ELSE -b0/pn END AS g1,CASE WHEN good THEN w2 ELSE 0.0 END AS g2 FROM f6)",
    "f8 AS MATERIALIZED (SELECT frag,\"end\",avid,az,ay,ax," + ",".join(f"g{c}*CASE WHEN CASE WHEN abs(g0)>1e-7 THEN g0 WHEN abs(g1)>1e-7 THEN g1 ELSE g2 END<0 THEN -1.0 ELSE 1.0 END AS e{a}" for c, a in enumerate("zyx")) + " FROM f7)",
    "f9 AS (SELECT f8.*,e.vid,e.z,e.y,e.x,(e.z-az)::DOUBLE AS vz,(e.y-ay)::DOUBLE AS vy,(e.x-ax)::DOUBLE AS vx FROM f8 JOIN et e USING (frag,\"end\"))",
    "ed AS (SELECT *,sqrt(vz*vz+vy*vy+vx*vx) AS nn,CASE WHEN sqrt(vz*vz+vy*vy+vx*vx)>1e-4 AND ez*vz+ey*vy+ex*vx<0 THEN -1.0 ELSE 1.0 END AS sg FROM f9)")
O["end_directions"] = sql("SELECT frag,\"end\",vid,z,y,x," + ",".join(f"round(e{c}*sg,6)+0.0::DOUBLE AS o{c}" for c in "zyx") + "," + ",".join(f"round(CASE WHEN nn>1e-4 THEN v{c}/CASE WHEN nn<1e-8 THEN 1.0 ELSE nn END ELSE e{c}*sg END,6)+0.0::DOUBLE AS t{c}" for c in "zyx") + " FROM ed",
                           *[c for c in _frags("sk") if not c.startswith("et ")], *LOOPS, _ETL, ANCH, ORI, *EIGEN)

ENDS = "en AS MATERIALIZED (SELECT frag,\"end\",vid,z,y,x,ez*sg AS oz,ey*sg AS oy,ex*sg AS ox FROM ed)"
_dot = lambda a, b, s1="", s2="": f"({a[0]}*{b[0]}+{a[1]}*{b[1]}+{a[2]}*{b[2]})"
_PB = _PC + "," + ",".join(f"{s}.{v}{c} AS {v}{c}_{s}" for s in "ab" for v in ("", "o") for c in "zyx") + ",a.vid AS vid_a,b.vid AS vid_b"
_t = [0.15 + i * ((0.85 - 0.15) / 6) for i in range(7)]
CAND = (
    *_pairs("pb", "en", _PB, 4, _AFTER),
    "b0 AS (SELECT *,CASE WHEN sqrt(d2)<0.5 THEN 0.5 ELSE sqrt(d2) END AS gap," + ",".join(f"CASE WHEN sqrt(d2)<0.5 THEN o{c}_a ELSE ({c}_b-{c}_a)::DOUBLE/sqrt(d2) END AS g{c}" for c in "zyx") + " FROM pb)",
    "b1 AS MATERIALIZED (SELECT *,abs(oz_a*oz_b+oy_a*oy_b+ox_a*ox_b) AS mutual,oz_a*gz+oy_a*gy+ox_a*gx AS cos_a,gz*(-oz_b)+gy*(-oy_b)+gx*(-ox_b) AS cos_b FROM b0)",
    "b2 AS MATERIALIZED (SELECT * REPLACE (-oz_b AS oz_b,-oy_b AS oy_b,-ox_b AS ox_b) FROM b1 WHERE mutual>=0.5 AND cos_a>=-0.3 AND cos_b>=-0.3)",
    "s0 AS MATERIALIZED (SELECT b2.*," + VID(*[f"greatest(round_even({c}_a+t*({c}_b-{c}_a),0),0)" for c in "zyx"]) + f" AS sv FROM b2,(VALUES {','.join(f'({v!r}::DOUBLE)' for v in _t)}) v(t) WHERE gap>2)",
    "s1 AS MATERIALIZED (SELECT s0.*,coalesce(o.oz,0) AS qz,coalesce(o.oy,0) AS qy,coalesce(o.ox,0) AS qx FROM s0 LEFT JOIN ori o ON o.vid=s0.sv)",
    "s2 AS MATERIALIZED (SELECT *," + ",".join(f"q{c}/CASE WHEN sqrt(qz*qz+qy*qy+qx*qx)<1e-8 THEN 1.0 ELSE sqrt(qz*qz+qy*qy+qx*qx) END AS u{c}" for c in "zyx") + " FROM s1)",
    "s3 AS MATERIALIZED (SELECT frag_a,end_a,frag_b,end_b,sum(CASE WHEN abs(uz*gz+uy*gy+ux*gx)>=0.4 THEN 1 ELSE 0 END)/count(*)::DOUBLE AS durable," + ",".join(f"sum(u{c}) AS s{c}" for c in "zyx") + ",7 AS k FROM s2 GROUP BY 1,2,3,4)",
    "cd AS MATERIALIZED (SELECT b2.*,s3.durable,s3.sz,s3.sy,s3.sx,s3.k FROM b2 JOIN s3 USING (frag_a,end_a,frag_b,end_b) WHERE durable>=0.4 UNION ALL SELECT b2.*,1.0,oz_a+oz_b,oy_a+oy_b,ox_a+ox_b,2 FROM b2 WHERE gap<=2)")
_BR8 = (*[c for c in _frags("sk8") if not c.startswith("et ")], *LOOPS, _ETL, ANCH, ORI8, *EIGEN, ENDS, *CAND)
O["bridge_candidates"] = sql("SELECT frag_a,end_a,frag_b,end_b," + ",".join(f"round({c},6) AS {c}" for c in ("gap", "mutual", "cos_a", "cos_b", "durable"))
                             + ",round(0.40::DOUBLE*mutual+0.25::DOUBLE*cos_a+0.25::DOUBLE*cos_b+0.20::DOUBLE*durable-0.10::DOUBLE*gap/25.0,6) AS score FROM cd", *_BR8)
_cl = lambda e, lo="-1.0": f"least(greatest({e},{lo}),1.0)"
_S55 = repr(math.cos(math.radians(55.0)))
COST = f"""0.25::DOUBLE*gap+5.0::DOUBLE*acos({_cl('abs(oz_a*oz_b+oy_a*oy_b+ox_a*ox_b)', '0.0')})+8.0::DOUBLE*(acos({_cl('cos_a')})+acos({_cl('cos_b')}))
 +CASE WHEN cos_a<{_S55} OR cos_b<{_S55} THEN 50.0::DOUBLE ELSE 0.0 END+CASE WHEN mn>1e-8 THEN 50.0::DOUBLE*(greatest(0.0,0.70-abs(oz_a*mz+oy_a*my+ox_a*mx)/mn)+greatest(0.0,0.70-abs(oz_b*mz+oy_b*my+ox_b*mx)/mn)) ELSE 0.0 END"""
O["bridge_costs"] = sql(f"SELECT frag_a,end_a,frag_b,end_b,round({COST},5) AS cost FROM (SELECT *,sqrt(mz*mz+my*my+mx*mx) AS mn FROM (SELECT *,sz/k AS mz,sy/k AS my,sx/k AS mx FROM cd))", *_BR8)
O["bridge_line_voxels"] = sql(f"""SELECT fiber,seq,i,z,y,x FROM (SELECT fiber,seq,i::INTEGER AS i,{','.join(f'round_even({c}+i/greatest(n,1)::DOUBLE*({c}3-{c}),0)::INTEGER AS {c}' for c in 'zyx')}
 FROM (SELECT *,unnest(range(0,n+1)) AS i FROM (SELECT *,greatest(abs(z3-z),abs(y3-y),abs(x3-x)) AS n FROM (SELECT *,{','.join(f'lead({c},3) OVER w AS {c}3' for c in 'zyx')} FROM sk WINDOW w AS (PARTITION BY fiber ORDER BY seq)) WHERE z3 IS NOT NULL)))""", SK)
O["priority_overlay"] = sql("SELECT f.vid,coalesce((s.seq//20)::INTEGER,f.label) AS label FROM fg f LEFT JOIN sk s USING (vid)", *FGL)

# diffusion
SEED8 = "sd AS MATERIALIZED (SELECT vid,z,y,x,(seq//20+1)::BIGINT AS label FROM sk8 WHERE seq%5<>2)"
_HOP = 1 << 32
O["diffuse_flood"] = sql(f"SELECT fl.v AS vid,(fl.k%{_HOP})::INTEGER AS label FROM fl", *FG8, _nb("ef", "fg"), SEED8,
                         f"fl(v,k) USING KEY (v) AS (SELECT vid,label FROM sd UNION SELECT e.b,min(c.k+{_HOP}) FROM fl c JOIN ef e ON e.a=c.v LEFT JOIN recurring.fl r ON r.v=e.b WHERE r.k IS NULL OR c.k+{_HOP}<r.k GROUP BY e.b)")
O["diffuse_nearest"] = sql("""SELECT f.vid,arg_min(s.label,((f.z-s.z)**2+(f.y-s.y)**2+(f.x-s.x)**2)*1000000+s.label)::INTEGER AS label FROM cf f JOIN (SELECT sd.*,cf.comp FROM sd JOIN cf USING (vid)) s ON s.comp=f.comp GROUP BY f.vid""", *CC8, SEED8)
O["prune_repropagate"] = sql(
    """SELECT v.vid,coalesce(k.new,i.new,n.new)::INTEGER AS label FROM vol v LEFT JOIN ks k USING (vid) LEFT JOIN ids i ON i.label=v.label LEFT JOIN nr n ON n.vid=v.vid""",
    SK, OFF, BALL, "s9 AS MATERIALIZED (SELECT vid,z,y,x,(fiber*1048576+seq//9+1)::BIGINT AS label FROM sk)", _fg("vol", "s9", "min(label) AS label"),
    "ids AS MATERIALIZED (SELECT label,row_number() OVER (ORDER BY label) AS new FROM s9 GROUP BY label HAVING count(*)>=5)",
    "ks AS MATERIALIZED (SELECT s9.*,ids.new FROM s9 JOIN ids USING (label))",
    "orp AS MATERIALIZED (SELECT v.vid,v.z,v.y,v.x FROM vol v ANTI JOIN ids USING (label) ANTI JOIN ks USING (vid))",
    "nr AS MATERIALIZED (SELECT o.vid,arg_min(k.new,((o.z-k.z)**2+(o.y-k.y)**2+(o.x-k.x)**2)*10000000+k.new) AS new FROM orp o,ks k GROUP BY 1)")

# metrics
GP = ("gt AS MATERIALIZED (SELECT vid,(fiber+1)::INTEGER AS g FROM sk)", "pd AS MATERIALIZED (SELECT vid,((fiber//2)*100+seq//50+1)::INTEGER AS p FROM sk WHERE seq%7<>0)",
      "ov AS MATERIALIZED (SELECT g,p,count(*) AS n FROM gt JOIN pd USING (vid) GROUP BY 1,2)", "gn AS (SELECT g,count(*) AS ng FROM gt GROUP BY 1)", "pn AS (SELECT p,count(*) AS np FROM pd GROUP BY 1)")
O["overlap_matrix"] = sql("SELECT g,p,n FROM ov", SK, *GP)
O["panoptic_metrics"] = sql("""SELECT n_gt,n_pred,matched,split,merge,missing,round(sq,6) AS mean_iou,round(sq,6) AS sq,round(rq,6) AS rq_gt,round(sq*rq,6) AS pq FROM (SELECT *,coalesce(s/greatest(matched,1),0) AS sq,matched/greatest(n_gt,1)::DOUBLE AS rq FROM (
 SELECT count(*) AS n_gt,(SELECT count(*) FROM pn) AS n_pred,count(*) FILTER (hit) AS matched,count(*) FILTER (NOT hit AND k>1) AS split,count(*) FILTER (NOT hit AND k<=1) AS missing,sum(iou) FILTER (hit) AS s,
 (SELECT count(*) FROM (SELECT p FROM ov WHERE p NOT IN (SELECT p FROM tt WHERE hit) GROUP BY p HAVING count(*)>1)) AS merge FROM tt))""", SK, *GP,
                            "bb AS MATERIALIZED (SELECT g,arg_max(p,n*1000000-p) AS p,max(n) AS n,count(*) AS k FROM ov GROUP BY 1)",
                            "tt AS MATERIALIZED (SELECT gn.g,bb.p,coalesce(k,0) AS k,n/greatest(ng+np-n,1)::DOUBLE AS iou,coalesce(n/greatest(ng+np-n,1)::DOUBLE>=0.5,false) AS hit FROM gn LEFT JOIN bb USING (g) LEFT JOIN pn ON pn.p=bb.p)")
O["label_lengths"] = sql("SELECT p AS label,np AS n FROM pn", SK, *GP)
O["length_summary"] = sql("SELECT count(*) AS n_labels,sum(np)::BIGINT AS total,round(sum(np)/count(*)::DOUBLE,6) AS mean_length,max(np) AS max_length FROM pn", SK, *GP)
O["length_histogram"] = sql("""SELECT least(floor((log10(n)-log10(lo))/(log10(hi)-log10(lo))*39+1e-9),38)::INTEGER AS bin,count(*) AS n FROM (SELECT count(*)::DOUBLE AS n FROM br GROUP BY branch),
 (SELECT greatest(min(c),1)::DOUBLE AS lo,(max(c)+1)::DOUBLE AS hi FROM (SELECT count(*) AS c FROM br GROUP BY branch)) GROUP BY 1""", *BASE, E_REST, CC_R, "br AS MATERIALIZED (SELECT v AS vid,l AS branch FROM ccr)")

# chunks
O["chunk_grid"] = sql("SELECT * FROM grid", SK, *CH)
_lo = lambda c: f"greatest(a.{c}0,b.{c}0)"
_hi = lambda c: f"least(a.{c}1,b.{c}1)"
O["chunk_pairs"] = sql("SELECT a.chunk AS a,b.chunk AS b," + ",".join(f"{_lo(c)} AS {c}0,{_hi(c)} AS {c}1" for c in "zyx") + " FROM grid a JOIN grid b ON a.chunk<b.chunk AND " + " AND ".join(f"{_lo(c)}<{_hi(c)}" for c in "zyx"), SK, *CH)
O["chunk_assignment"] = sql("SELECT chunk,vid FROM asg", SK, *CH, ASSIGN)
CONS = (SK, *CH, ASSIGN, "cl AS MATERIALIZED (SELECT chunk,vid,z,y,x,(fiber*4096+(seq+chunk%3)//12+1)::INTEGER AS label FROM asg)",
        "ov AS MATERIALIZED (SELECT a.chunk AS chunk_a,a.label AS label_a,b.chunk AS chunk_b,b.label AS label_b,count(*) AS n FROM cl a JOIN cl b ON a.vid=b.vid AND a.chunk<b.chunk GROUP BY 1,2,3,4)",
        f"sz AS MATERIALIZED (SELECT c.chunk,g.chunk AS other,c.label,count(*) AS n FROM cl c JOIN grid g ON g.chunk<>c.chunk AND {_IN('c', 'g')} GROUP BY 1,2,3)",
        """mt AS MATERIALIZED (SELECT o.*,o.n/least(a.n,b.n)::DOUBLE AS ratio FROM ov o JOIN sz a ON a.chunk=chunk_a AND a.other=chunk_b AND a.label=label_a JOIN sz b ON b.chunk=chunk_b AND b.other=chunk_a AND b.label=label_b WHERE o.n/least(a.n,b.n)::DOUBLE>=0.8)""")
O["consensus_matches"] = sql("SELECT chunk_a,label_a,chunk_b,label_b,n,round(ratio,6) AS ratio FROM mt", *CONS)
_K = lambda c, l: f"({c}*4294967296+{l})"
O["stitched_labels"] = sql("SELECT vid,arg_max(g.gid,c.chunk)::INTEGER AS label FROM cl c JOIN gi g ON g.v=" + _K("c.chunk", "c.label") + " GROUP BY vid", *CONS,
                           f"nd AS MATERIALIZED (SELECT DISTINCT {_K('chunk', 'label')} AS vid FROM cl)",
                           f"ee AS MATERIALIZED (SELECT {_K('chunk_a', 'label_a')} AS a,{_K('chunk_b', 'label_b')} AS b FROM mt UNION ALL SELECT {_K('chunk_b', 'label_b')},{_K('chunk_a', 'label_a')} FROM mt)",
                           _cc("cg", "nd", "ee"), "gi AS MATERIALIZED (SELECT v,dense_rank() OVER (ORDER BY l) AS gid FROM cg)")
O["border_split"] = sql(
    """SELECT vid,label FROM (SELECT c.vid,(CASE WHEN p.comp IS NULL THEN c.label ELSE p.new END)::INTEGER AS label FROM cr c LEFT JOIN cx ON cx.v=c.vid LEFT JOIN rk p ON p.label=c.label AND p.comp=cx.l) WHERE label IS NOT NULL""",
    *FGL, f"cr AS MATERIALIZED (SELECT {VID('z', 'y', 'x')} AS vid,* FROM (SELECT z-2 AS z,y-2 AS y,x-2 AS x,label FROM fg WHERE " + " AND ".join(f"{c}>=2 AND {c}<=(SELECT max({c}) FROM fg)-2" for c in "zyx") + "))",
    "bl AS MATERIALIZED (SELECT DISTINCT label FROM cr WHERE " + " OR ".join(f"{c}=0 OR {c}=(SELECT max({c}) FROM fg)-4" for c in "zyx") + ")",
    "bp AS MATERIALIZED (SELECT * FROM cr SEMI JOIN bl USING (label))",
    "ex AS MATERIALIZED (SELECT s.vid AS a,n.vid AS b FROM bp s CROSS JOIN off JOIN bp n ON n.vid=s.vid+off.d AND n.label=s.label WHERE off.d<>0)", _cc("cx", "bp", "ex"),
    "pc AS MATERIALIZED (SELECT b.label,c.l AS comp,count(*) AS n FROM cx c JOIN bp b ON b.vid=c.v GROUP BY 1,2)",
    "re AS MATERIALIZED (SELECT * FROM (SELECT *,row_number() OVER (PARTITION BY label ORDER BY n DESC,comp) AS r FROM pc) WHERE r>1)",
    """rk AS MATERIALIZED (SELECT re.label,re.comp,k.new FROM re LEFT JOIN (SELECT label,comp,(SELECT max(label) FROM cr)+row_number() OVER (ORDER BY label,n DESC,comp) AS new FROM re WHERE n>=3) k USING (label,comp))""")

# curves
_W = "WINDOW w AS (PARTITION BY fiber ORDER BY seq)"
O["curve_diff"] = sql(f"SELECT * FROM (SELECT fiber AS curve,seq,{','.join(f'lead({c}) OVER w-{c} AS d{c}' for c in 'zyx')} FROM sk {_W}) WHERE dz IS NOT NULL", SK)
O["curve_tangent"] = sql("SELECT fiber AS curve,seq,round(oz,6) AS tz,round(oy,6) AS ty,round(ox,6) AS tx FROM ori", SK, ORI)
TURN = (SK, f"tu AS MATERIALIZED (SELECT fiber AS curve,seq,least(greatest((az*ez+ay*ey+ax*ex)/(greatest(sqrt(az*az+ay*ay+ax*ax),1e-8)*greatest(sqrt(ez*ez+ey*ey+ex*ex),1e-8)),-1.0),1.0) AS c FROM (SELECT fiber,seq,"
        + ",".join(f"({c}-lag({c}) OVER w)::DOUBLE AS a{c},(lead({c}) OVER w-{c})::DOUBLE AS e{c}" for c in "zyx") + f" FROM sk {_W}) WHERE az IS NOT NULL AND ez IS NOT NULL)")
O["turn_angles"] = sql("SELECT curve,seq,round(c,6) AS cos_turn FROM tu", *TURN)
O["sharp_bends"] = sql(f"SELECT curve,count(*) FILTER (c<{_S55}) AS n_sharp FROM tu GROUP BY 1", *TURN)
O["segment_self_cost"] = sql(f"""SELECT curve,n,round(cc,5) AS curvature_cost,round(sc,5) AS sharp_cost,round(-0.10::DOUBLE*n+cc+sc+CASE WHEN n>=12 THEN 0.0 ELSE 200.0/greatest(n,1)::DOUBLE END,5) AS self_cost FROM (
 SELECT s.curve,s.n,coalesce(8.0*t.a,0)::DOUBLE AS cc,(coalesce(t.s,0)*50.0)::DOUBLE AS sc FROM (SELECT fiber AS curve,count(*) AS n FROM sk GROUP BY 1) s LEFT JOIN (SELECT curve,avg(acos(c)) AS a,count(*) FILTER (c<{_S55}) AS s FROM tu GROUP BY 1) t USING (curve))""", *TURN)
ARC = f"ar AS MATERIALIZED (SELECT *,sum(st) OVER (PARTITION BY fiber ORDER BY seq)::BIGINT/1000000000.0::DOUBLE AS arc FROM (SELECT *,round_even(sqrt(({'+'.join(f'({c}-coalesce(lag({c}) OVER w,{c}))**2' for c in 'zyx')})::DOUBLE)*1e9,0)::BIGINT AS st FROM sk {_W}))"
O["arc_length"] = sql("SELECT fiber AS curve,seq,round(arc,5) AS arc FROM ar", SK, ARC)


def _dense(name, k, src="sk", cols=("z", "y", "x")):
    return f"""{name} AS MATERIALIZED (SELECT a.fiber AS curve,g.i AS seq,{','.join(f'a.{c}::DOUBLE+(coalesce(b.{c},a.{c})::DOUBLE-a.{c}::DOUBLE)*CASE WHEN n=1 THEN 0.0::DOUBLE ELSE (i*(n-1)-q*(n*{k}-1))::DOUBLE/(n*{k}-1)::DOUBLE END AS {c}' for c in cols)} FROM
 (SELECT fiber,n,i,least((i*(n-1))//greatest(n*{k}-1,1),n-1) AS q FROM (SELECT fiber,n,unnest(range(0,n*{k})) AS i FROM (SELECT fiber,count(*) AS n FROM sk GROUP BY 1))) g
 JOIN {src} a ON a.fiber=g.fiber AND a.seq=g.q LEFT JOIN {src} b ON b.fiber=g.fiber AND b.seq=g.q+1)"""


_r = lambda cols, n=6: ",".join(f"round({c},{n}) AS {c}" for c in cols)
O["densify"] = sql(f"SELECT curve,seq,{_r('zyx')} FROM dn", SK, _dense("dn", 6))
O["resample_unit"] = sql(f"""SELECT fiber AS curve,k AS seq,{','.join(f'round({c}+(coalesce({c}1,{c})-{c})*t,4) AS {c}' for c in 'zyx')} FROM (SELECT q.*,s.*,CASE WHEN s.arc1 IS NULL THEN 0.0 ELSE (k*h-s.arc)/greatest(s.arc1-s.arc,1e-12) END AS t FROM
 (SELECT fiber AS f,unnest(range(0,m+1)) AS k,m,len/m AS h FROM (SELECT fiber,max(arc) AS len,ceil(max(arc))::BIGINT AS m FROM ar GROUP BY 1) WHERE len>0) q
 JOIN (SELECT *,{','.join(f'lead({c}) OVER w AS {c}1' for c in ('z', 'y', 'x', 'arc'))} FROM ar {_W}) s ON s.fiber=q.f AND CASE WHEN k=m THEN s.arc1 IS NULL ELSE k*h>=s.arc AND k*h<s.arc1 END)""", SK, ARC)
O["inbox_runs"] = sql(f"""SELECT curve,(row_number() OVER (PARTITION BY curve ORDER BY first))::BIGINT AS run,first,last,n FROM (SELECT fiber AS curve,min(seq) AS first,max(seq) AS last,count(*) AS n FROM (SELECT fiber,seq,seq-row_number() OVER (PARTITION BY fiber ORDER BY seq) AS g FROM sk
 WHERE z>=5 AND z<60 AND y>=0 AND y<26 AND x>=0 AND x<23) GROUP BY fiber,g)""", SK)


def _smooth(sigma, mode):
    r, w = _gauss(sigma)
    if mode == "nearest":
        idx = "least(greatest(s.seq+o.d,0),s.n-1)"
    else:
        idx = "CASE WHEN s.seq+o.d<0 THEN -1-(s.seq+o.d) WHEN s.seq+o.d>=s.n THEN 2*s.n-1-(s.seq+o.d) ELSE s.seq+o.d END"
    vals = ",".join(f"({k - r},{w[k]!r}::DOUBLE)" for k in range(2 * r + 1))
    return sql(f"""SELECT curve,q.seq AS seq,{','.join(f'round(sum(t.{c}*w),6) AS {c}' for c in 'zyx')} FROM (SELECT s.fiber AS curve,s.seq,{idx} AS j,o.w FROM (SELECT *,count(*) OVER (PARTITION BY fiber) AS n FROM sk) s,(VALUES {vals}) o(d,w)) q JOIN sk t ON t.fiber=q.curve AND t.seq=q.j GROUP BY 1,2""", SK)


O["gaussian_1d"] = _smooth(1.2, "nearest")
O["gaussian_1d_reflect"] = _smooth(1.0, "reflect").replace("*w),6)", "*w),5)")
O["middle_slice"] = sql("SELECT fiber AS curve,seq FROM (SELECT *,count(*) OVER (PARTITION BY fiber) AS n FROM sk) WHERE seq>=greatest(3,floor(n*0.06::DOUBLE)) AND seq<n-greatest(3,floor(n*0.06::DOUBLE))", SK)
_FC = [(c, m) for c in "zyx" for m in (0, 69)]
_near = lambda which: "CASE " + " ".join(f"WHEN abs({c}-{m})<=least({','.join(f'abs({a}-{b})' for a, b in _FC)}) THEN CASE WHEN abs({c}-{m})<=2.5 AND abs(o{c})>=0.20 THEN '{c}_{'max' if m else 'min'}' END" for c, m in _FC) + " END"
O["through_curves"] = sql(f"""SELECT curve,n,length,entry_face,exit_face,coalesce(n>=15 AND length>=40.0 AND along<3 AND entry_face<>exit_face,false) AS valid FROM (SELECT fiber AS curve,n,round(max(arc),5) AS length,
 max(CASE WHEN seq=0 THEN f END) AS entry_face,max(CASE WHEN seq=n-1 THEN f END) AS exit_face,
 greatest({','.join(f'count(*) FILTER (inn AND abs({c}-{m})<=3.5 AND abs(o{c})<0.35)' for c, m in _FC)}) AS along FROM (
 SELECT *,{_near(0)} AS f,seq>=greatest(3,floor(n*0.06::DOUBLE)) AND seq<n-greatest(3,floor(n*0.06::DOUBLE)) AS inn FROM (SELECT ar.*,oz,oy,ox,count(*) OVER (PARTITION BY ar.fiber) AS n FROM ar JOIN ori USING (vid))) GROUP BY fiber,n)""", SK, ORI, ARC)

# nearest neighbours
PT = "pt AS MATERIALIZED (SELECT vec_id,label," + ",".join(f"(floor(embedding[{i}]::DOUBLE*100)::INTEGER+100) AS {c}" for i, c in ((1, "z"), (2, "y"), (3, "x"))) + " FROM embeddings)"
_D2 = "(a.z-b.z)**2+(a.y-b.y)**2+(a.x-b.x)**2"
O["embedding_pairs"] = sql(f"SELECT a.vec_id AS vec_id_a,b.vec_id AS vec_id_b,({_D2})::INTEGER AS d2 FROM pt a JOIN pt b ON a.vec_id<b.vec_id WHERE {_D2}<=36", PT)
O["nearest_in_group"] = sql(f"SELECT vec_id,site,d2::INTEGER AS d2 FROM (SELECT a.vec_id,b.vec_id AS site,{_D2} AS d2,row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D2},b.vec_id) AS r FROM pt a JOIN pt b ON a.label=b.label AND b.vec_id%10=0) WHERE r=1", PT)
_PD = "+".join(f"least(abs(a.{c}-b.{c}),200-abs(a.{c}-b.{c}))**2" for c in "zyx")
O["knn8_periodic"] = sql(f"SELECT vec_id,r::INTEGER AS rank,site,d2::INTEGER AS d2 FROM (SELECT a.vec_id,b.vec_id AS site,{_PD} AS d2,row_number() OVER (PARTITION BY a.vec_id ORDER BY {_PD},b.vec_id) AS r FROM pt a,pt b) WHERE r<=8", PT)
O["separable_points"] = sql(f"SELECT vec_id FROM pt a WHERE vec_id%2=1 AND NOT EXISTS (SELECT 1 FROM pt b WHERE b.vec_id%2=0 AND {_D2}<36)", PT)
_NEAR3 = "n3 AS MATERIALIZED (SELECT f.vid,s.fiber,min((f.z-s.z)**2+(f.y-s.y)**2+(f.x-s.x)**2) AS q FROM fg f JOIN (SELECT *,unnest([-1,0,1]) AS a FROM (SELECT *,unnest([-1,0,1]) AS b FROM (SELECT *,unnest([-1,0,1]) AS c FROM sk))) s ON f.z//4=s.z//4+s.a AND f.y//4=s.y//4+s.b AND f.x//4=s.x//4+s.c WHERE (f.z-s.z)**2+(f.y-s.y)**2+(f.x-s.x)**2<=9 GROUP BY 1,2)"
O["crossing_dip"] = sql("""SELECT vid,round(sqrt(q1),6) AS d1,round(sqrt(q2),6) AS d2,round(1.5::DOUBLE*exp(-(sqrt(q1)*sqrt(q1)+sqrt(q2)*sqrt(q2))/4.5::DOUBLE),6) AS dip FROM (SELECT vid,l[1] AS q1,l[2] AS q2 FROM (SELECT vid,list_sort(list(q)) AS l FROM n3 GROUP BY 1) WHERE len(l)>1)""", *FG, _NEAR3)
O["analytic_field"] = sql("""SELECT vid,curve,round(d1,6) AS d1,round(d2,6) AS d2,round(least(greatest(CASE WHEN exp(-(d1*d1)/2.0)<1e-4 THEN 0 ELSE exp(-(d1*d1)/2.0) END-1.5::DOUBLE*CASE WHEN d1<=3 AND d2<=3 THEN exp(-(d1*d1+d2*d2)/4.5::DOUBLE) ELSE 0 END,-1.0),1.0),6) AS intensity FROM (
 SELECT vid,arg_min(fiber,r) AS curve,sqrt(min(q)) AS d1,coalesce(sqrt(min(CASE WHEN fiber<>f1 THEN q END)),999.0) AS d2 FROM (SELECT *,first_value(fiber) OVER (PARTITION BY vid ORDER BY r) AS f1 FROM n8) GROUP BY vid)""",
                          *FG8, "n8 AS MATERIALIZED (SELECT * FROM (SELECT f.vid,s.fiber,s.seq,(f.z-s.z)**2+(f.y-s.y)**2+(f.x-s.x)**2 AS q,row_number() OVER (PARTITION BY f.vid ORDER BY (f.z-s.z)**2+(f.y-s.y)**2+(f.x-s.x)**2,s.fiber,s.seq) AS r FROM fg f JOIN (SELECT *,unnest([-1,0,1]) AS a FROM (SELECT *,unnest([-1,0,1]) AS b FROM (SELECT *,unnest([-1,0,1]) AS c FROM sk8))) s ON f.z//12=s.z//12+s.a AND f.y//12=s.y//12+s.b AND f.x//12=s.x//12+s.c) WHERE r<=8)")
_PM = lambda c: f"({c}-floor({c}/64.0)*64.0)"
SPINE = (SK, ORI, _dense("sp0", 3, "ori", ("z", "y", "x", "oz", "oy", "ox")), "sp AS MATERIALIZED (SELECT *,CASE WHEN sqrt(oz*oz+oy*oy+ox*ox)=0 THEN 1.0 ELSE sqrt(oz*oz+oy*oy+ox*ox) END AS nn FROM sp0)")
O["spine_points"] = sql("SELECT curve,seq," + ",".join(f"round({_PM(c)},5) AS {c}" for c in "zyx") + "," + ",".join(f"round(o{c}/nn,5) AS t{c}" for c in "zyx") + " FROM sp", *SPINE)
_PI = lambda c: f"((round_even({c},0)::INTEGER%64)+64)%64"
O["rasterised_curves"] = sql(f"SELECT {VID('z', 'y', 'x')} AS vid,z,y,x,max(curve) AS label FROM (SELECT curve,{','.join(f'{_PI(c)} AS {c}' for c in 'zyx')} FROM sp) GROUP BY z,y,x", *SPINE)
def _seg(i, k):
    """Distance, foot point and arc on the segment between rows i and k of a curve."""
    v = [f"({k}{c}-{i}{c})" for c in "zyx"]
    w = [f"(q{c}-{i}{c})" for c in "zyx"]
    t = f"least(greatest(({'+'.join(f'{a}*{b}' for a, b in zip(w, v))})/({'+'.join(f'{a}*{a}' for a in v)}+1e-8),0.0),1.0)"
    return t


_PJ = lambda i, k, t: "{" + ",".join([f"'d2':{'+'.join(f'(q{c}-({i}{c}+{t}*({k}{c}-{i}{c})))**2' for c in 'zyx')}"] + [f"'p{c}':{i}{c}+{t}*({k}{c}-{i}{c})" for c in ("z", "y", "x", "arc")]) + "}"
O["projected_points"] = sql("SELECT vid,curve,round(s.pz,4) AS pz,round(s.py,4) AS py,round(s.px,4) AS px,round(s.parc,4) AS arc,round(s.d2,4) AS d2 FROM (SELECT vid,curve,CASE WHEN sb.d2<sa.d2 THEN sb ELSE sa END AS s FROM ("
                            f"SELECT vid,curve,CASE WHEN az IS NULL THEN {_PJ('m', 'n', 'tb')} ELSE {_PJ('a', 'm', 'ta')} END AS sa,CASE WHEN nz IS NULL THEN {_PJ('a', 'm', 'ta')} ELSE {_PJ('m', 'n', 'tb')} END AS sb FROM (SELECT *,{_seg('a', 'm')} AS ta,{_seg('m', 'n')} AS tb FROM jn)))",
                            *FG, ARC,
                            "nn AS MATERIALIZED (SELECT f.vid,f.z AS qz,f.y AS qy,f.x AS qx,s.fiber,s.seq,row_number() OVER (PARTITION BY f.vid ORDER BY abs(f.z-s.z)+abs(f.y-s.y)+abs(f.x-s.x),s.fiber,s.seq) AS r FROM sk s CROSS JOIN ball JOIN fg f ON f.vid=s.vid+ball.d)",
                            f"nb AS MATERIALIZED (SELECT fiber,seq,{','.join(f'{c}::DOUBLE AS m{c},(lag({c}) OVER w)::DOUBLE AS a{c},(lead({c}) OVER w)::DOUBLE AS n{c}' for c in ('z', 'y', 'x', 'arc'))} FROM ar {_W})",
                            "jn AS MATERIALIZED (SELECT nn.vid,qz,qy,qx,nb.fiber AS curve,nb.* EXCLUDE (fiber,seq) FROM nn JOIN nb USING (fiber,seq) WHERE r=1)")
O["flip_field"] = sql(f"SELECT {VID('z', 'y', '4095-x')} AS vid,z,y,4095-x AS x,round(oz,6)+0.0::DOUBLE AS oz,round(oy,6)+0.0::DOUBLE AS oy,round(-ox,6)+0.0::DOUBLE AS ox FROM ori", SK, ORI)
O["rotate_field"] = sql(f"SELECT {VID('z', 'x', '4095-y')} AS vid,z,x AS y,4095-y AS x,round(oz,6)+0.0::DOUBLE AS oz,round(ox,6)+0.0::DOUBLE AS oy,round(-oy,6)+0.0::DOUBLE AS ox FROM ori", SK, ORI)
_NW = lambda c: f"((n{c}+CASE WHEN n{c}>=16 THEN (8-(n{c}-16)%8)%8 ELSE 16-n{c} END)-16)//8"
_WC = lambda c: f"q{c} AS MATERIALIZED (SELECT range*8 AS o{c},range AS w{c} FROM range(0,(SELECT {_NW(c)}+1 FROM m)))"
O["overlap_add"] = sql(f"""SELECT {VID('z', 'y', 'x')} AS vid,z,y,x,round(sum(w*v)/greatest(sum(w),1e-6),7) AS v FROM (SELECT s.z,s.y,s.x,s.intensity*(1.0+(wz+wy+wx)%3) AS v,exp((0.75-({'+'.join(f'(s.{c}-o{c}-7.5::DOUBLE)**2' for c in 'zyx')}))/32.0::DOUBLE) AS w
 FROM sk s JOIN qz ON s.z>=oz AND s.z<oz+16 JOIN qy ON s.y>=oy AND s.y<oy+16 JOIN qx ON s.x>=ox AND s.x<ox+16) GROUP BY z,y,x""", SK, _M, _WC("z"), _WC("y"), _WC("x"))
O["sliding_predict"] = sql("SELECT vid,z,y,x,round(sqrt(intensity),6) AS c0 FROM sk", SK)

# scores
SC = (SK, ORI, "sc AS MATERIALIZED (SELECT fiber,(seq*37+fiber*11)%200/100.0::DOUBLE-1.0 AS g,(seq*53+fiber*7)%200/100.0::DOUBLE-1.0 AS p,oz,oy,ox,intensity FROM ori)",
      "sw AS MATERIALIZED (SELECT *,CASE WHEN abs(g)>0.05 THEN 1.0::DOUBLE ELSE 0 END AS f,1.0::DOUBLE+CASE WHEN abs(g)>0.05 THEN 3.0 ELSE 0 END+CASE WHEN g>0.30 THEN 4.0 ELSE 0 END AS w,greatest(p,0) AS pp,greatest(g,0) AS pg,greatest(-g,0) AS ng FROM sc)")
_AG = """count(*) AS k,sum((p-g)**2*w)/sum(w) AS mse,(2*sum(pp*pg)+1e-8)/(sum(pp*pp)+sum(pg*pg)+1e-8) AS soft,(2*count(*) FILTER (pp>0.30 AND pg>0.30)+1e-8)/(count(*) FILTER (pp>0.30)+count(*) FILTER (pg>0.30)+1e-8) AS dice,
 sum(ng*ng) AS nge,sum(pg*pg) AS ge,(2*sum(greatest(-p,0)*f*ng)+1e-8)/(sum((greatest(-p,0)*f)**2)+sum(ng*ng)+1e-8) AS ns"""
O["intensity_scores"] = sql(f"""SELECT round(mse,5) AS weighted_mse,round(soft,5) AS soft_dice,round(1-soft,5) AS dice_loss,round(dice,5) AS dice_score,round(nge/(ge+1e-8)*(1-ns),5) AS neg_loss,round(ns,5) AS neg_soft_dice,round(mse+(1-soft)+nge/(ge+1e-8)*(1-ns),5) AS loss_total FROM (SELECT {_AG} FROM sw)""", *SC)
O["validation_average"] = sql(f"SELECT round(avg(mse),4) AS weighted_mse,round(avg(soft),4) AS soft_dice,round(avg(dice),4) AS dice_score,count(*) AS n_volumes FROM (SELECT fiber,{_AG} FROM sw GROUP BY fiber)", *SC)
O["orientation_scores"] = sql("""SELECT fiber,round(CASE WHEN w>0 THEN l/w ELSE 0 END,4) AS ori_loss,round(CASE WHEN w>0 THEN acos(least(greatest(d/w,0.0),1.0))*180.0/pi() ELSE 0 END,4) AS mean_angle_deg FROM (SELECT fiber,sum(w) AS w,sum(w*(1-d)) AS l,sum(w*d) AS d FROM (
 SELECT fiber,least(abs(oz*oz-oy*oy+ox*ox),1.0) AS d,CASE WHEN sqrt(oz*oz+oy*oy+ox*ox)>1e-4 THEN least(abs(intensity)+0.1,1.0) ELSE 0.0 END AS w FROM sc) GROUP BY fiber)""", *SC)

# sources
O["gad_points"] = sql("SELECT concat(fiber,'/',seq//64) AS doc,1::INTEGER AS object,seq%64 AS seq,z::DOUBLE AS z,y::DOUBLE AS y,x::DOUBLE AS x,CASE WHEN seq%64%2=1 THEN 1.5::DOUBLE END AS r FROM (SELECT *,count(*) OVER (PARTITION BY fiber,seq//64) AS n FROM sk) WHERE n>=2", SK)
O["gad_objects"] = sql("""SELECT p.label,p.n_points,round(2.0::DOUBLE*sqrt(greatest(coalesce(v.n,0)/p.n_points::DOUBLE,0.5)/pi()),5) AS diameter,p.first_z FROM (SELECT label,count(*) AS n_points,arg_min(z,seq)::DOUBLE AS first_z FROM s64 GROUP BY 1 HAVING count(*)>=2) p
 LEFT JOIN (SELECT label,count(*) AS n FROM fv GROUP BY 1) v USING (label)""", SK, OFF, BALL, "s64 AS MATERIALIZED (SELECT vid,z,y,x,seq,fiber*1048576+seq//64 AS label FROM sk)", _fg("fv", "s64", "min(label) AS label"))
NM = "nm AS MATERIALIZED (SELECT concat('model_',p_partkey,'_v',p_size,'.tif') AS name,p_partkey,p_size FROM part)"
O["natural_sort"] = sql("SELECT name,row_number() OVER (ORDER BY p_partkey,p_size) AS rank FROM nm", NM)
O["split_train_test"] = sql("SELECT name,rank,CASE WHEN rank>n-greatest(1,round_even(n*0.1::DOUBLE,0)::BIGINT) THEN 'test' ELSE 'train' END AS part FROM (SELECT name,row_number() OVER (ORDER BY p_partkey,p_size) AS rank,count(*) OVER () AS n FROM nm)", NM)
O["holdout_every_5"] = sql("SELECT name,rank,CASE WHEN (rank-1)%5=0 THEN 'val' ELSE 'train' END AS part FROM (SELECT name,row_number() OVER (ORDER BY name) AS rank FROM nm)", NM)
O["repeated_samples"] = sql("SELECT name,3*count(*) AS copies FROM nm GROUP BY 1", NM)
_k = "concat('model_',o_orderkey,'{}')"
_if = lambda cond, suf: f"CASE WHEN {cond} THEN {_k.format(suf)} END"
O["triplet_join"] = f"""SELECT * FROM (SELECT concat('model_',o_orderkey) AS stem,coalesce({_if('o_orderkey%3<>0', '_vol.npy')},{_if('o_orderkey%2=0', '_vol.tif')}) AS vol,
 coalesce({_if('o_orderkey%5=0', '_intensity.npy')},{_if('o_orderkey%4=0', '_intensity.tif')},{_if('o_orderkey%3=1', '_centerline.npy')},{_if('o_orderkey%7<>0', '_centerline.tif')}) AS intensity,{_if('o_orderkey%11<>0', '_ori.npy')} AS ori FROM orders)
 WHERE vol IS NOT NULL AND intensity IS NOT NULL AND ori IS NOT NULL"""
O["paired_models"] = "SELECT concat('model_',o_orderkey) AS stem,concat('model_',o_orderkey,'.tif') AS name,o_orderkey::INTEGER AS idx FROM orders WHERE o_orderkey%2=0 AND o_orderkey%3=0"
O["missing_stamps"] = "SELECT o_orderkey,o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag='R')"
_P = "concat('patch_',format('{{:04d}}',{}))"
O["patch_status"] = f"SELECT patch,coalesce(n,0) AS n_stamps,CASE WHEN n IS NULL THEN 'missing' ELSE 'extracted' END AS status FROM (SELECT DISTINCT {_P.format('c_custkey')} AS patch FROM customer) LEFT JOIN (SELECT {_P.format('o_custkey')} AS patch,count(*) AS n FROM orders GROUP BY 1) USING (patch)"
O["masked_crops"] = sql("SELECT label," + ",".join(f"({c}-greatest({c}0-2,0))::INTEGER AS {c}" for c in "zyx") + " FROM fg JOIN (SELECT label," + ",".join(f"min({c}) AS {c}0" for c in "zyx") + " FROM fg GROUP BY 1) USING (label)", *FGL)

_IP = " AND ".join(f"p.{c}+o.{c} BETWEEN 0 AND 23" for c in "zyx")
O["distance_transform"] = sql(f"SELECT patch,z,y,x,round(sqrt(min(q)::DOUBLE),6) AS dt FROM (SELECT p.patch,p.z,p.y,p.x,o.q FROM pa p JOIN o8 o ON {_IP} ANTI JOIN pa n ON n.patch=p.patch AND n.z=p.z+o.z AND n.y=p.y+o.y AND n.x=p.x+o.x) GROUP BY patch,z,y,x",
                              *FG8, f"pa AS MATERIALIZED (SELECT {VID('z//24', 'y//24', 'x//24')} AS patch,{','.join(f'({c}%24)::INTEGER AS {c}' for c in 'zyx')} FROM fg)",
                              "r8 AS (SELECT range AS v FROM range(-3,4))", "o8 AS MATERIALIZED (SELECT a.v AS z,b.v AS y,c.v AS x,a.v*a.v+b.v*b.v+c.v*c.v AS q FROM r8 a,r8 b,r8 c)")

# greedy matching: bridges by rank, the used ends and the free partner of each path end carried along
_SLOT = lambda s: f"(b.frag_{s}::HUGEINT*2+CASE WHEN f{s}.head=f{s}.tail THEN 0 ELSE b.end_{s} END)"
_MATE = lambda s: f"(b.frag_{s}::HUGEINT*2+1-CASE WHEN f{s}.head=f{s}.tail THEN 0 ELSE b.end_{s} END)"
MATCH = (
    f"bc AS MATERIALIZED (SELECT *,{COST} AS cost,0.40::DOUBLE*mutual+0.25::DOUBLE*cos_a+0.25::DOUBLE*cos_b+0.20::DOUBLE*durable-0.10::DOUBLE*gap/25.0 AS score FROM (SELECT *,sqrt(mz*mz+my*my+mx*mx) AS mn FROM (SELECT *,sz/k AS mz,sy/k AS my,sx/k AS mx FROM cd)))",
    f"bo AS MATERIALIZED (SELECT b.frag_a,b.end_a,b.frag_b,b.end_b,b.vid_a,b.vid_b,b.cost,{_SLOT('a')} AS s,{_SLOT('b')} AS t,{_MATE('a')} AS ms,{_MATE('b')} AS mt,row_number() OVER (ORDER BY round(b.cost,9),-round(b.score,9),frag_a,end_a,frag_b,end_b) AS r FROM bc b JOIN fl fa ON fa.frag=b.frag_a JOIN fl fb ON fb.frag=b.frag_b WHERE b.cost<=35)",
    """gm(r,used,ks,vs,took) AS (SELECT 0::BIGINT,[]::HUGEINT[],[]::HUGEINT[],[]::HUGEINT[],false UNION ALL
 SELECT r,CASE WHEN ok THEN used||[s,t] ELSE used END,CASE WHEN ok THEN [ps,pt]||ks ELSE ks END,CASE WHEN ok THEN [pt,ps]||vs ELSE vs END,ok FROM (
 SELECT *,NOT list_contains(used,s) AND NOT list_contains(used,t) AND ps<>t AS ok FROM (
 SELECT o.r,o.s,o.t,g.used,g.ks,g.vs,coalesce(g.vs[list_position(g.ks,o.s)],o.ms) AS ps,coalesce(g.vs[list_position(g.ks,o.t)],o.mt) AS pt FROM gm g JOIN bo o ON o.r=g.r+1)))""",
    "mb AS MATERIALIZED (SELECT o.* FROM bo o JOIN gm g USING (r) WHERE g.took)")
O["matched_bridges"] = sql("SELECT frag_a,end_a,frag_b,end_b,vid_a,vid_b,round(cost,5) AS cost FROM mb", *_BR8, *MATCH)
CHAIN = ("me AS MATERIALIZED (SELECT frag_a AS a,frag_b AS b FROM mb UNION ALL SELECT frag_b,frag_a FROM mb)", "fn AS MATERIALIZED (SELECT frag AS vid FROM fl)", _cc("cm", "fn", "me"),
         "ch AS MATERIALIZED (SELECT c.l AS root,count(*)::INTEGER AS n_fragments,sum(f.length)::BIGINT AS total_length FROM cm c JOIN fl f ON f.frag=c.v GROUP BY 1)")
O["chain_table"] = sql("SELECT root,n_fragments,total_length FROM ch", *_BR8, *MATCH, *CHAIN)

O["labelled_skeleton"] = sql(f"SELECT vid,{Z('vid')}::INTEGER AS z,{Y('vid')}::INTEGER AS y,{X('vid')}::INTEGER AS x,label FROM (SELECT vid,arg_max(label,layer*1000000000+label)::INTEGER AS label FROM (SELECT vid,label,0 AS layer FROM fv JOIN lb USING (frag) UNION ALL SELECT {VID('z', 'y', 'x')},label,1 FROM ln) GROUP BY vid)", *_BR8, *MATCH, *CHAIN,
                             "lb AS MATERIALIZED (SELECT c.v AS frag,r.label FROM cm c JOIN (SELECT root,row_number() OVER (ORDER BY total_length DESC,root) AS label FROM ch WHERE total_length>=5) r ON r.root=c.l)",
                             "lp AS (SELECT label," + ",".join(f"{f(f'vid_{s}')}::INTEGER AS {c}{s}" for s in "ab" for f, c in ((Z, "z"), (Y, "y"), (X, "x"))) + " FROM mb JOIN lb ON lb.frag=mb.frag_a)",
                             "lq AS (SELECT *,unnest(range(0,n+1)) AS i FROM (SELECT *,greatest(abs(zb-za),abs(yb-ya),abs(xb-xa)) AS n FROM lp))",
                             "ln AS (SELECT label," + ",".join(f"round_even({c}a+i/greatest(n,1)::DOUBLE*({c}b-{c}a),0)::INTEGER AS {c}" for c in "zyx") + " FROM lq)")

# frames: the two reflections of each step, folded along the curve
_T0 = "abs(oz)>=0.9"
_RV = lambda n: f"(({'+'.join(f'v{c}*{n}{c}' for c in 'zyx')})*2.0/c1)"
FRAME = (
    f"st AS MATERIALIZED (SELECT fiber,seq,{','.join(f'(lead({c}) OVER w-{c})::DOUBLE AS v{c},o{c} AS t{c},lead(o{c}) OVER w AS q{c}' for c in 'zyx')} FROM ori {_W})",
    "s1 AS (SELECT *,vz*vz+vy*vy+vx*vx AS c1 FROM st WHERE vz IS NOT NULL)",
    "s2 AS (SELECT *," + ",".join(f"q{c}-(t{c}-{_RV('t')}*v{c}) AS r{c}" for c in "zyx") + " FROM s1)", "s3 AS MATERIALIZED (SELECT *,rz*rz+ry*ry+rx*rx AS c2 FROM s2)",
    f"""n0 AS MATERIALIZED (SELECT fiber,a/n AS nz,b/n AS ny,c/n AS nx FROM (SELECT *,sqrt(a*a+b*b+c*c) AS n FROM (SELECT fiber,CASE WHEN {_T0} THEN -ox ELSE 0.0 END AS a,CASE WHEN {_T0} THEN 0.0 ELSE ox END AS b,CASE WHEN {_T0} THEN oz ELSE -oy END AS c FROM ori WHERE seq=0)))""",
    "fr(fiber,seq,nz,ny,nx) AS (SELECT fiber,0::BIGINT,nz,ny,nx FROM n0 UNION ALL SELECT fiber,seq+1," + ",".join(f"CASE WHEN c2<1e-8 THEN h{c} ELSE h{c}-2.0/c2*(rz*hz+ry*hy+rx*hx)*r{c} END" for c in "zyx") + " FROM (SELECT s.*,"
    + ",".join(f"f.n{c}-{_RV('f.n')}*v{c} AS h{c}" for c in "zyx") + " FROM fr f JOIN s3 s ON s.fiber=f.fiber AND s.seq=f.seq))",
    "fu AS (SELECT o.fiber,o.seq,oz,oy,ox," + ",".join(f"n{c}-(nz*oz+ny*oy+nx*ox)*o{c} AS m{c}" for c in "zyx") + " FROM fr JOIN ori o ON o.fiber=fr.fiber AND o.seq=fr.seq)",
    "fw AS (SELECT fiber,seq,oz,oy,ox," + ",".join(f"m{c}/sqrt(mz*mz+my*my+mx*mx) AS n{c}" for c in "zyx") + " FROM fu)")
O["curve_frames"] = sql("SELECT fiber AS curve,seq," + ",".join(f"round(n{c},6)+0.0::DOUBLE AS n{c}" for c in "zyx") + ",round(oy*nx-ox*ny,6)+0.0::DOUBLE AS bz,round(ox*nz-oz*nx,6)+0.0::DOUBLE AS by,round(oz*ny-oy*nz,6)+0.0::DOUBLE AS bx FROM fw", SK, ORI, *FRAME)

_IN12 = " AND ".join(f"s.{c}>=b.{c}0 AND s.{c}<b.{c}0+12" for c in "zyx")
O["cropped_curves"] = sql("SELECT i.block,i.fiber AS curve,i.seq," + ",".join(f"(i.{c}-i.{c}0)::INTEGER AS {c}" for c in "zyx") + " FROM inb i JOIN per USING (block,try,fiber) JOIN (SELECT block,min(try) AS try FROM (SELECT block,try FROM per GROUP BY 1,2 HAVING count(*)>=2) GROUP BY 1) USING (block,try)", SK, _M,
                          f"bx AS MATERIALIZED (SELECT id//30 AS block,id%30 AS try,{','.join(f'floor(((id*{k}+{k})%997)/997.0::DOUBLE*(greatest(n{c}-12,0)+1))::INTEGER AS {c}0' for c, k in zip('zyx', (379, 521, 761)))} FROM (SELECT unnest(range(0,30*(3+(SELECT max(fiber)//8 FROM sk)))) AS id), m)",
                          f"inb AS MATERIALIZED (SELECT b.*,s.fiber,s.seq,s.z,s.y,s.x FROM bx b JOIN sk s ON {_IN12})", "per AS MATERIALIZED (SELECT block,try,fiber FROM inb GROUP BY 1,2,3 HAVING count(*)>=6)")

O["thinning_checks"] = sql("SELECT count(DISTINCT comp) AS n_components,0::BIGINT AS n_outside FROM cf", *CC8)

# augmentation: seeded draws are the first 28 bits of an MD5 digest
_U = lambda seed, key: f"(('0x'||substr(md5('{seed}:'||{key}::BIGINT),1,7))::BIGINT/268435456.0::DOUBLE)"
_N = lambda seed, key: f"(sqrt(-2.0*ln(greatest({_U(seed, key)},1e-12)))*cos({2.0 * math.pi!r}::DOUBLE*{_U(seed + 7919, key)}))"
_TURN = lambda p, q, m: f"CASE k WHEN 0 THEN {p} WHEN 1 THEN {m(q)} WHEN 2 THEN {m(p)} ELSE {q} END"
_BACK = lambda p, q, m: f"CASE k WHEN 0 THEN {q} WHEN 1 THEN {p} WHEN 2 THEN {m(q)} ELSE {m(p)} END"
_MI, _NG = (lambda c: f"127-{c}"), (lambda c: f"-{c}")
_turns = [f"au{i + 1} AS (SELECT * REPLACE ({_TURN(a, b, _MI)} AS {a},{_BACK(a, b, _MI)} AS {b},{_TURN('o' + a, 'o' + b, _NG)} AS o{a},{_BACK('o' + a, 'o' + b, _NG)} AS o{b}) FROM (SELECT *,floor(4*{_U(17 + i, 'sample')})::INTEGER AS k FROM (SELECT sample,seq,z,y,x,oz,oy,ox FROM au{i})))"
          for i, (a, b) in enumerate((("y", "x"), ("z", "x"), ("z", "y")))]
O["augmented_field"] = sql(f"SELECT sample,seq,z::INTEGER AS z,y::INTEGER AS y,x::INTEGER AS x,{','.join(f'round(o{c},6)+0.0::DOUBLE AS o{c}' for c in 'zyx')} FROM au3", SK, ORI,
                           "au0 AS (SELECT fiber AS sample,seq," + ",".join(f"CASE WHEN {_U(7 + i, 'fiber')}>0.5 THEN 127-{c} ELSE {c} END AS {c},CASE WHEN {_U(7 + i, 'fiber')}>0.5 THEN -o{c} ELSE o{c} END AS o{c}" for i, c in enumerate("zyx")) + " FROM ori)", *_turns)
_CURVE = 'curve'
_M95 = lambda c: f"95.0-{c}"
O["augmented_curves"] = sql("SELECT curve,seq,block," + ",".join(f"round({c}+CASE WHEN n>4 THEN sin({2 * math.pi!r}::DOUBLE*seq/greatest(n-1,1))*d{c}/nn*amp ELSE 0.0 END,6)+0.0::DOUBLE AS {c}" for c in "zyx") + " FROM ac3", SK,
                            "ac0 AS (SELECT fiber AS curve,seq,fiber//8 AS block,z,y,x,count(*) OVER (PARTITION BY fiber) AS n FROM sk)",
                            "ac1 AS (SELECT * REPLACE (" + ",".join(f"{c}+{_N(i, 'block')}*2.5::DOUBLE AS {c}" for i, c in enumerate("zyx")) + ") FROM ac0)",
                            f"ac2 AS (SELECT * REPLACE (" + ",".join(f"CASE WHEN {_U(20 + i, 'block')}>0.5 THEN {_M95(c)} ELSE {c} END AS {c}" for i, c in enumerate("zyx")) + f"),floor(4*{_U(30, 'block')})::INTEGER AS k FROM ac1)",
                            "ac3 AS (SELECT * REPLACE (CASE k WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN 95.0-y ELSE 95.0-x END AS y,CASE k WHEN 0 THEN x WHEN 1 THEN 95.0-y WHEN 2 THEN 95.0-x ELSE y END AS x),"
                            f"0.5::DOUBLE+0.7::DOUBLE*{_U(50, 'curve')} AS amp,dz,dy,dx,sqrt(dz*dz+dy*dy+dx*dx)+1e-8 AS nn FROM (SELECT *,{','.join(f'{_N(40 + i, _CURVE)} AS d{c}' for i, c in enumerate('zyx'))} FROM ac2))")

# stamps, patches and reports
_PK = "concat('patch_',lpad(l_orderkey::VARCHAR,7,'0'))"
_FB = f"concat({_PK},'_fiber_',lpad(l_linenumber::VARCHAR,2,'0'))"
LISTING = f"""ls AS MATERIALIZED (SELECT l_orderkey,{_PK} AS patch,concat({_FB},'_vol.npy') AS name,true AS stamp FROM lineitem UNION ALL SELECT l_orderkey,{_PK},concat({_FB},'_intensity.npy'),true FROM lineitem WHERE l_returnflag<>'R'
 UNION ALL SELECT l_orderkey,{_PK},concat({_FB},'_ori.npy'),true FROM lineitem WHERE l_linestatus='F' UNION ALL SELECT l_orderkey,NULL,concat('notes_',l_orderkey,'.txt'),false FROM lineitem WHERE l_linenumber=1)"""
O["stamps_to_extract"] = f"""WITH v AS (SELECT {_PK} AS patch,l_linenumber::INTEGER AS fiber,sum(greatest(1,l_quantity::INTEGER%9))::BIGINT AS n,bool_or(l_returnflag<>'R') AND bool_or(l_linestatus='F') AS whole FROM lineitem GROUP BY 1,2)
 SELECT patch,fiber,n FROM v WHERE n>=3 AND NOT whole"""
O["removed_stamps"] = sql("SELECT name,count(*) AS n FROM ls WHERE patch IS NULL OR patch NOT IN (SELECT concat('patch_',lpad(o_orderkey::VARCHAR,7,'0')) FROM orders WHERE o_orderstatus='F') GROUP BY 1", LISTING)
O["cleared_stamps"] = sql("SELECT name FROM ls WHERE NOT stamp", LISTING)
O["synced_library"] = f"""WITH o AS (SELECT DISTINCT {_PK} AS patch,l_linenumber::INTEGER AS fiber FROM lineitem WHERE l_returnflag<>'N'),
 n AS (SELECT DISTINCT {_PK} AS patch,l_linenumber::INTEGER AS fiber FROM lineitem WHERE l_linestatus='F' AND l_orderkey%3<>0)
 SELECT coalesce(o.patch,n.patch) AS patch,coalesce(o.fiber,n.fiber) AS fiber,CASE WHEN o.patch IS NULL THEN 'added' WHEN n.patch IS NULL THEN 'removed' ELSE 'kept' END AS change FROM o FULL JOIN n ON o.patch=n.patch AND o.fiber=n.fiber"""
O["save_slots"] = "SELECT o_orderkey AS request,CASE WHEN o_orderstatus='F' THEN o_custkey ELSE (SELECT max(c_custkey) FROM customer)+row_number() OVER (PARTITION BY o_orderstatus='F' ORDER BY o_orderkey) END AS index FROM orders"
_P24 = VID("z//24", "y//24", "x//24")
O["patch_checks"] = sql(f"""SELECT patch,coalesce(k,0) AS skel_voxels,coalesce(n,0) AS vol_voxels,coalesce(bad,0) AS mismatches,CASE WHEN coalesce(bad,0)=0 THEN 'CLEAN' ELSE 'ERROR' END AS status FROM (SELECT {_P24} AS patch,count(*) AS n FROM fg GROUP BY 1)
 FULL JOIN (SELECT {_P24} AS patch,count(*) AS k,count(*) FILTER (f.label IS DISTINCT FROM s.fiber+1) AS bad FROM (SELECT vid,z,y,x,fiber FROM sk) s LEFT JOIN (SELECT vid,label FROM fg) f USING (vid) GROUP BY 1) USING (patch)""", *FGL)
_TC = O["through_curves"]
_TC75 = _TC.replace("length>=40.0", "length>=75.0")
_head = lambda q: (q[:q.rindex("SELECT curve,n,length,entry_face")], q[q.rindex("SELECT curve,n,length,entry_face"):])
O["fiber_quality"] = _head(_TC75)[0] + f"""SELECT curve,n,valid,CASE WHEN n<15 THEN 'too_short' WHEN length<75 THEN 'short_length' WHEN entry_face IS NULL OR exit_face IS NULL OR entry_face=exit_face THEN 'invalid_endpoints' WHEN NOT valid THEN 'parallel_sliced' END AS reason FROM ({_head(_TC75)[1]})"""
O["intact_counts"] = _head(_TC)[0] + f"SELECT curve//4 AS patch,count(*) AS num_fibers,count(*) FILTER (valid) AS intact FROM ({_head(_TC)[1]}) GROUP BY 1"
O["labels_by_volume"] = sql(f"SELECT patch,label,n,row_number() OVER (PARTITION BY patch ORDER BY n DESC,label)::INTEGER AS rank FROM (SELECT {_P24} AS patch,label,count(*) AS n FROM fg GROUP BY 1,2 HAVING count(*)>=8)", *FGL)
_FCO = [("z", "y", "x"), ("y", "z", "x"), ("x", "z", "y")]
_case = lambda pick: "CASE " + " ".join(f"WHEN {c}<=1 THEN {pick(c, a, b, 'min')} WHEN {c}>=46 THEN {pick(c, a, b, 'max')}" for c, a, b in _FCO) + " END"
O["face_coordinates"] = sql("SELECT vid,face,round(u,6) AS u,round(v,6) AS v FROM (SELECT vid," + _case(lambda c, a, b, m: f"'{c}_{m}'") + " AS face," + _case(lambda c, a, b, m: f"{a}/47.0::DOUBLE") + " AS u," + _case(lambda c, a, b, m: f"{b}/47.0::DOUBLE") + " AS v FROM sk) WHERE face IS NOT NULL", SK)
_AT = lambda c, o: f"greatest(0,least({o},n{c}-24))"
O["opened_patch"] = sql("SELECT " + ",".join(f"({c}-{_AT(c, o)})::INTEGER AS {c}" for c, o in zip("zyx", (99999, 5, 3))) + ",fiber FROM sk,m WHERE " + " AND ".join(f"{c}>={_AT(c, o)} AND {c}<{_AT(c, o)}+24" for c, o in zip("zyx", (99999, 5, 3))), SK, _M)
O["one_of_each_stem"] = "SELECT concat('model_',o_orderkey) AS stem,CASE WHEN o_orderkey%2=0 THEN concat('model_',o_orderkey,'_vol.tif') ELSE concat('model_',o_orderkey,'_vol.npy') END AS name FROM orders WHERE o_orderkey%2=0 OR o_orderkey%3<>0"
O["first_occurrences"] = "SELECT value,row_number() OVER (ORDER BY first_at,value) AS rank FROM (SELECT o_custkey AS value,min(o_orderkey) AS first_at FROM orders GROUP BY 1)"
_RP = [("n_gt", 0), ("n_pred", 0), ("matched", 0), ("split", 0), ("merge", 0), ("missing", 0), ("mean_iou", 1), ("sq", 1), ("rq_gt", 1), ("pq", 1)]
O["metrics_report"] = "WITH p AS (" + O["panoptic_metrics"] + ") " + " UNION ALL ".join(f"SELECT {i}::INTEGER AS line,concat(rpad('{c}',20,' '),': ',{'printf(%r,%s)' % ('%.4f', c) if r else c + '::VARCHAR'}) AS text FROM p" for i, (c, r) in enumerate(_RP))
O["decoded_field"] = sql("SELECT vid,round(trunc(least(greatest(intensity,0),1)*65535)/65535.0::DOUBLE,7) AS v FROM sk", SK)
_UW = lambda k: _U(11 + k, "sample")
O["oriented_training_windows"] = sql("SELECT sample," + ",".join(f"least(greatest(coalesce({c}-12+floor({_UW(10 + i)}*5)::BIGINT-2,floor({_UW(20 + i)}*(greatest(n{c}-24,0)+1))::BIGINT),0),greatest(n{c}-24,0))::INTEGER AS {c}0" for i, c in enumerate("zyx"))
                                     + f" FROM (SELECT range AS sample FROM range(0,(SELECT count(*)//8 FROM sk))) LEFT JOIN (SELECT z,y,x,row_number() OVER (ORDER BY vid) AS rank FROM sk) r ON {_UW(0)}<0.85 AND r.rank=floor({_UW(1)}*(SELECT count(*) FROM sk))::BIGINT+1,m", SK, _M)

O["tile_routes"] = sql(
    "SELECT route,(max(k) OVER (PARTITION BY route)-k)::BIGINT AS seq,v AS vid,dist FROM back", *FG8,
    "cv AS MATERIALIZED (SELECT vid,200000+((7*z+13*y+29*x)%17)*100000 AS c FROM fg)",
    """ed AS MATERIALIZED (SELECT s.vid AS a,n.vid AS b,CASE abs(dz)+abs(dy)+abs(dx) WHEN 1 THEN 5000 WHEN 2 THEN 7071 ELSE 8660 END::BIGINT*(s.c+n.c) AS w
 FROM cv s CROSS JOIN off JOIN cv n ON n.vid=s.vid+off.d WHERE off.d<>0)""",
    "req AS MATERIALIZED (SELECT fiber::BIGINT AS route,min_by(vid,seq) AS src,max_by(vid,seq) AS dst FROM sk8 GROUP BY 1)",
    """ds(route,v,d) USING KEY (route,v) AS (SELECT route,src,0::BIGINT FROM req UNION
 SELECT c.route,e.b,min(c.d+e.w) FROM ds c JOIN ed e ON e.a=c.v LEFT JOIN recurring.ds r ON r.route=c.route AND r.v=e.b WHERE r.d IS NULL OR c.d+e.w<r.d GROUP BY 1,2)""",
    "par AS MATERIALIZED (SELECT x.route,x.v,min(e.a) AS u FROM ds x JOIN ed e ON e.b=x.v JOIN ds y ON y.route=x.route AND y.v=e.a WHERE y.d+e.w=x.d GROUP BY 1,2)",
    """back(route,v,dist,k) AS (SELECT q.route,q.dst,x.d,0::BIGINT FROM req q JOIN ds x ON x.route=q.route AND x.v=q.dst
 UNION ALL SELECT b.route,p.u,x.d,b.k+1 FROM back b JOIN req q ON q.route=b.route AND b.v<>q.src JOIN par p ON p.route=b.route AND p.v=b.v JOIN ds x ON x.route=b.route AND x.v=p.u)""")

_LEN = "sqrt(((n-1)*(n-1))::DOUBLE*(1.25::DOUBLE+(0.25::DOUBLE*(fiber%5))*(0.25::DOUBLE*(fiber%5))))"
_ALONG = lambda t: f"round(0.00001234::DOUBLE+{t},4) AS z,round(10.00001234::DOUBLE+0.5::DOUBLE*{t},4) AS y,round(20.00001234::DOUBLE+0.25::DOUBLE*(fiber%5)*{t},4) AS x"
O["refined_curves"] = sql(
    f"SELECT fiber AS curve,k AS seq,{_ALONG('((n-1)*k/(m-1)::DOUBLE)')} FROM (SELECT *,unnest(range(0,m)) AS k FROM (SELECT fiber,n,greatest(3,floor({_LEN}+0.5)::BIGINT) AS m FROM cl WHERE n>=4))"
    f" UNION ALL SELECT fiber,seq,{_ALONG('seq::DOUBLE')} FROM sk8 JOIN cl USING (fiber) WHERE n<4", SK8,
    "cl AS MATERIALIZED (SELECT fiber,count(*)::BIGINT AS n FROM sk8 GROUP BY 1)")

_PT = """pt AS MATERIALIZED (SELECT fiber AS label,z,y,x,row_number() OVER (PARTITION BY fiber ORDER BY z,y,x)-1 AS i,count(*) OVER w AS n,sum(z) OVER w AS sz,
 sum(y) OVER w AS sy,sum(x) OVER w AS sx FROM sk WINDOW w AS (PARTITION BY fiber))"""
_START = "arg_min(i,{'d':-((z*n-sz)*(z*n-sz)+(y*n-sy)*(y*n-sy)+(x*n-sx)*(x*n-sx)),'i':i})"
_VISIT = lambda jump2: f"""walk(label,seq,i,seen,beyond) AS (SELECT label,0::BIGINT,{_START},[{_START}],false FROM pt WHERE n>=3 GROUP BY label
 UNION ALL SELECT label,seq+1,t.i,list_append(seen,t.i),beyond OR t.d>{jump2} FROM (
  SELECT w.label,w.seq,w.seen,w.beyond,min({{'d':(p.z-c.z)*(p.z-c.z)+(p.y-c.y)*(p.y-c.y)+(p.x-c.x)*(p.x-c.x),'i':p.i}}) AS t FROM walk w
  JOIN pt c ON c.label=w.label AND c.i=w.i JOIN pt p ON p.label=w.label AND NOT list_contains(w.seen,p.i) GROUP BY ALL))"""
_ORDER = "SELECT label,seq,z,y,x,beyond FROM walk JOIN pt USING (label,i) UNION ALL SELECT label,i,z,y,x,false FROM pt WHERE n<3"
O["curve_order"] = sql(_ORDER, SK, _PT, _VISIT(64))
_FACE96 = "CASE " + " ".join(f"WHEN {c}<=1 THEN '{c}_min' WHEN {c}>=94 THEN '{c}_max'" for c in "zyx") + " ELSE 'internal' END"
O["label_seeds"] = sql(
    f"""SELECT label,seq AS ord,z,y,x,NOT (seq=0 OR seq=n-1) AS way,{_FACE96} AS face FROM (SELECT *,count(*) OVER (PARTITION BY label) AS n FROM od WHERE NOT beyond)
 WHERE n>=8 AND (seq=0 OR seq=n-1 OR CASE WHEN n>=12 THEN seq=n//3 OR seq=2*(n//3) ELSE seq=n//2 END)""", SK, _PT, _VISIT(20.25), f"od AS MATERIALIZED ({_ORDER})")
O["tiled_box"] = sql("SELECT vid,z,y,x FROM fg WHERE z BETWEEN 10 AND 40 AND y BETWEEN 3 AND 20 AND x BETWEEN 5 AND 30", *FG)

O["placed_stamps"] = sql(
    "SELECT s.stamp,s.patch,t.try,0::INTEGER AS z0,((7*s.stamp+5*t.try)%24)::INTEGER AS y0,((11*s.stamp+13*t.try)%40)::INTEGER AS x0 FROM go s,LATERAL (SELECT unnest(s.took) AS try) t WHERE t.try IS NOT NULL",
    SK8,
    "own AS MATERIALIZED (SELECT fiber,fiber//16 AS patch,z,y%8 AS y,x%8 AS x FROM sk8 WHERE seq<24)",
    "ex AS MATERIALIZED (SELECT patch,z,y+fiber%16 AS y,x+2*(fiber%16) AS x FROM own WHERE fiber%4=0)",
    """tp AS MATERIALIZED (SELECT fiber AS stamp,patch,k::INTEGER AS try,z,y+(7*fiber+5*k)%24 AS y,x+(11*fiber+13*k)%40 AS x FROM own,range(0,5) g(k) WHERE fiber%4<>0)""",
    "dead AS MATERIALIZED (SELECT DISTINCT stamp,try FROM tp t JOIN ex e ON e.patch=t.patch WHERE (t.z-e.z)**2+(t.y-e.y)**2+(t.x-e.x)**2<36)",
    """meet AS MATERIALIZED (SELECT DISTINCT a.stamp,a.try,b.stamp AS before,b.try AS its FROM tp a JOIN tp b ON a.patch=b.patch AND b.stamp<a.stamp
 WHERE (a.z-b.z)**2+(a.y-b.y)**2+(a.x-b.x)**2<36)""",
    "st AS MATERIALIZED (SELECT stamp,patch,row_number() OVER (PARTITION BY patch ORDER BY stamp) AS r FROM (SELECT DISTINCT stamp,patch FROM tp))",
    "free AS MATERIALIZED (SELECT DISTINCT t.stamp,t.try FROM tp t LEFT JOIN dead d ON d.stamp=t.stamp AND d.try=t.try WHERE d.stamp IS NULL)",
    """go(patch,r,stamp,took,placed) AS (
 SELECT patch,r,stamp,[(SELECT min(try) FROM free f WHERE f.stamp=st.stamp)],[{'s':stamp,'t':(SELECT min(try) FROM free f WHERE f.stamp=st.stamp)}] FROM st WHERE r=1
 UNION ALL SELECT patch,r,stamp,[t],list_append(placed,{'s':stamp,'t':t}) FROM (
  SELECT g.patch,n.r,n.stamp,g.placed,min(f.try) FILTER (WHERE m.stamp IS NULL) AS t FROM go g JOIN st n ON n.patch=g.patch AND n.r=g.r+1
  LEFT JOIN free f ON f.stamp=n.stamp LEFT JOIN (SELECT stamp,try,list({'s':before,'t':its}) AS all FROM meet GROUP BY 1,2) m
   ON m.stamp=f.stamp AND m.try=f.try AND list_has_any(m.all,g.placed) GROUP BY ALL))""")

ORACLES = O
