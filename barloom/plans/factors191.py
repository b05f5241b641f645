"""The 191 published short-horizon alphas, in the notation of barloom.functions.algebra.

Factor 30 is the form without style series; with them, barloom.operators.regression
gives the residuals."""

#: Formula text by factor number. E stands for 1e-10.
FORMULAS = {
    1: "-CORR(RANK(DELTA(LOG(V),1)),RANK((C-O)/(O+E)),6)",
    2: "-DELTA((C-L-(H-C))/(H-L+E),1)",
    3: "SUM(IF(C=DELAY(C,1),0,IF(C>DELAY(C,1),C-MIN2(L,DELAY(C,1)),C-MAX2(H,DELAY(C,1)))),6)",
    4: "IF(MEAN(C,8)+STD(C,8)<MEAN(C,2),-1,IF(MEAN(C,2)<MEAN(C,8)-STD(C,8),1,IF(V/(MEAN(V,20)+E)>=1,1,-1)))",
    5: "-TSMAX(CORR(TSRANK(V,5),TSRANK(H,5),5),3)",
    6: "-RANK(SIGN(DELTA(O*0.85+H*0.15,4)))",
    7: "(RANK(TSMAX(VW-C,3))+RANK(TSMIN(VW-C,3)))*RANK(DELTA(V,3))",
    8: "RANK(-DELTA((H+L)/2*0.2+VW*0.8,4))",
    9: "EMA(((H+L)/2-(DELAY(H,1)+DELAY(L,1))/2)*(H-L)/(V+E),7,2)",
    10: "RANK(TSMAX(IF(RET<0,STD(RET,20),C)^2,5))",
    11: "SUM((C-L-(H-C))/(H-L+E)*V,6)",
    12: "RANK(O-SUM(VW,10)/10)*(-RANK(ABS(C-VW)))",
    13: "(H*L)^0.5-VW",
    14: "C-DELAY(C,5)",
    15: "O/(DELAY(C,1)+E)-1",
    16: "-TSMAX(RANK(CORR(RANK(V),RANK(VW),5)),5)",
    17: "SPOW(RANK(VW-TSMAX(VW,15)),DELTA(C,5))",
    18: "C/(DELAY(C,5)+E)",
    19: "IF(C<DELAY(C,5),(C-DELAY(C,5))/(DELAY(C,5)+E),IF(C=DELAY(C,5),0,(C-DELAY(C,5))/(C+E)))",
    20: "(C-DELAY(C,6))/(DELAY(C,6)+E)*100",
    21: "SLOPE(MEAN(C,6),6)",
    22: "EMA(a-DELAY(a,3),12,1)  WITH a=(C-MEAN(C,6))/(MEAN(C,6)+E)",
    23: "EMA(IF(a,STD(C,20),0),20,1)/(EMA(IF(a,STD(C,20),0),20,1)+EMA(IF(NOT(a),STD(C,20),0),20,1)+E)*100  WITH a=C>DELAY(C,1)",
    24: "EMA(C-DELAY(C,5),5,1)",
    25: "-RANK(DELTA(C,7)*(1-RANK(DECAY(V/(MEAN(V,20)+E),9))))*(1+RANK(SUM(RET,250)))",
    26: "SUM(C,7)/7-C+CORR(VW,DELAY(C,5),230)",
    27: "WMA((C-DELAY(C,3))/(DELAY(C,3)+E)*100+(C-DELAY(C,6))/(DELAY(C,6)+E)*100,12)",
    28: "3*a-2*EMA(a,3,1)  WITH a=EMA((C-TSMIN(L,9))/(TSMAX(H,9)-TSMIN(L,9)+E)*100,3,1)",
    29: "(C-DELAY(C,6))/(DELAY(C,6)+E)*V",
    30: "WMA((C/DELAY(C,1)-1)^2,20)",
    31: "(C-MEAN(C,12))/(MEAN(C,12)+E)*100",
    32: "-SUM(RANK(CORR(RANK(H),RANK(V),3)),3)",
    33: "(-TSMIN(L,5)+DELAY(TSMIN(L,5),5))*RANK((SUM(RET,240)-SUM(RET,20))/220)*TSRANK(V,5)",
    34: "MEAN(C,12)/(C+E)",
    35: "-MIN2(RANK(DECAY(DELTA(O,1),15)),RANK(DECAY(CORR(V,O,17),7)))",
    36: "RANK(SUM(CORR(RANK(V),RANK(VW),6),2))",
    37: "-RANK(a-DELAY(a,10))  WITH a=SUM(O,5)*SUM(RET,5)",
    38: "IF(SUM(H,20)/20<H,-DELTA(H,2),0)",
    39: "-(RANK(DECAY(DELTA(C,2),8))-RANK(DECAY(CORR(VW*0.3+O*0.7,SUM(MEAN(V,180),37),14),12)))",
    40: "SUM(IF(a,V,0),26)/(SUM(IF(NOT(a),V,0),26)+E)*100  WITH a=C>DELAY(C,1)",
    41: "-RANK(TSMAX(DELTA(VW,3),5))",
    42: "-RANK(STD(H,10))*CORR(H,V,10)",
    43: "SUM(IF(C>DELAY(C,1),V,IF(C<DELAY(C,1),-V,0)),6)",
    44: "TSRANK(DECAY(CORR(L,MEAN(V,10),7),6),4)+TSRANK(DECAY(DELTA(VW,3),10),15)",
    45: "RANK(DELTA(C*0.6+O*0.4,1))*RANK(CORR(VW,MEAN(V,150),15))",
    46: "(MEAN(C,3)+MEAN(C,6)+MEAN(C,12)+MEAN(C,24))/(4*C+E)",
    47: "EMA((TSMAX(H,6)-C)/(TSMAX(H,6)-TSMIN(L,6)+E)*100,9,1)",
    48: "-RANK(SIGN(C-DELAY(C,1))+SIGN(DELAY(C,1)-DELAY(C,2))+SIGN(DELAY(C,2)-DELAY(C,3)))*SUM(V,5)/(SUM(V,20)+E)",
    49: "c/(c+SUM(IF(NOT(a),0,b),12)+E)  WITH a=H+L>=DELAY(H,1)+DELAY(L,1); b=MAX2(ABS(H-DELAY(H,1)),ABS(L-DELAY(L,1))); c=SUM(IF(a,0,b),12)",
    50: "c/(c+d+E)-d/(d+c+E)  WITH a=DELAY(H,1)+DELAY(L,1); b=MAX2(ABS(H-DELAY(H,1)),ABS(L-DELAY(L,1))); c=SUM(IF(H+L<=a,0,b),12); d=SUM(IF(H+L>=a,0,b),12)",
    51: "c/(c+SUM(IF(NOT(a),0,b),12)+E)  WITH a=H+L<=DELAY(H,1)+DELAY(L,1); b=MAX2(ABS(H-DELAY(H,1)),ABS(L-DELAY(L,1))); c=SUM(IF(a,0,b),12)",
    52: "SUM(MAX2(0,H-a),26)/(SUM(MAX2(0,a-L),26)+E)*100  WITH a=DELAY((H+L+C)/3,1)",
    53: "COUNT(C>DELAY(C,1),12)/12*100",
    54: "-RANK(STD(ABS(C-O),10)+C-O+CORR(C,O,10))",
    55: "SUM(16*(C-DELAY(C,1)+(C-O)/2+DELAY(C,1)-DELAY(O,1))/(IF(a>b AND a>c,a+b/2+ABS(DELAY(C,1)-DELAY(O,1))/4,IF(b>c AND b>a,b+a/2+ABS(DELAY(C,1)-DELAY(O,1))/4,c+ABS(DELAY(C,1)-DELAY(O,1))/4))+E)*MAX2(a,b),20)  WITH a=ABS(H-DELAY(C,1)); b=ABS(L-DELAY(C,1)); c=ABS(H-DELAY(L,1))",
    56: "IF(RANK(O-TSMIN(O,12))<RANK(RANK(CORR(SUM((H+L)/2,19),SUM(MEAN(V,40),19),13))^5),1,0)",
    57: "EMA((C-TSMIN(L,9))/(TSMAX(H,9)-TSMIN(L,9)+E)*100,3,1)",
    58: "COUNT(C>DELAY(C,1),20)/20*100",
    59: "SUM(IF(C=DELAY(C,1),0,IF(C>DELAY(C,1),C-MIN2(L,DELAY(C,1)),C-MAX2(H,DELAY(C,1)))),20)",
    60: "SUM((C-L-(H-C))/(H-L+E)*V,20)",
    61: "-MAX2(RANK(DECAY(DELTA(VW,1),12)),RANK(DECAY(RANK(CORR(L,MEAN(V,80),8)),17)))",
    62: "-CORR(H,RANK(V),5)",
    63: "EMA(MAX2(a,0),6,1)/(EMA(ABS(a),6,1)+E)*100  WITH a=C-DELAY(C,1)",
    64: "-MAX2(RANK(DECAY(CORR(RANK(VW),RANK(V),4),4)),RANK(DECAY(TSMAX(CORR(RANK(C),RANK(MEAN(V,60)),4),13),14)))",
    65: "MEAN(C,6)/(C+E)",
    66: "(C-MEAN(C,6))/(MEAN(C,6)+E)*100",
    67: "EMA(MAX2(a,0),24,1)/(EMA(ABS(a),24,1)+E)*100  WITH a=C-DELAY(C,1)",
    68: "EMA(((H+L)/2-(DELAY(H,1)+DELAY(L,1))/2)*(H-L)/(V+E),15,2)",
    69: "IF(a>b,(a-b)/(a+E),IF(a=b,0,(a-b)/(b+E)))  WITH a=SUM(MAX2(MAX2(0,O-DELAY(O,1)),H-O),20); b=SUM(MAX2(MAX2(0,DELAY(O,1)-O),O-L),20)",
    70: "STD(AMT,6)",
    71: "(C-MEAN(C,24))/(MEAN(C,24)+E)*100",
    72: "EMA((TSMAX(H,6)-C)/(TSMAX(H,6)-TSMIN(L,6)+E)*100,15,1)",
    73: "-(TSRANK(DECAY(DECAY(CORR(C,V,10),16),4),5)-RANK(DECAY(CORR(VW,MEAN(V,30),4),3)))",
    74: "RANK(CORR(SUM(L*0.35+VW*0.65,20),SUM(MEAN(V,40),20),7))+RANK(CORR(RANK(VW),RANK(V),6))",
    75: "COUNT(C>O AND BMC<BMO,50)/(COUNT(BMC<BMO,50)+E)",
    76: "STD(a,20)/(MEAN(a,20)+E)  WITH a=ABS(C/(DELAY(C,1)+E)-1)/(V+E)",
    77: "MIN2(RANK(DECAY((H+L)/2+H-VW-H,20)),RANK(DECAY(CORR((H+L)/2,MEAN(V,40),3),6)))",
    78: "((H+L+C)/3-a)/(0.015*MEAN(ABS(C-a),12)+E)  WITH a=MEAN((H+L+C)/3,12)",
    79: "EMA(MAX2(a,0),12,1)/(EMA(ABS(a),12,1)+E)*100  WITH a=C-DELAY(C,1)",
    80: "(V-DELAY(V,5))/(DELAY(V,5)+E)*100",
    81: "EMA(V,21,2)",
    82: "EMA((TSMAX(H,6)-C)/(TSMAX(H,6)-TSMIN(L,6)+E)*100,20,1)",
    83: "-RANK(COV(RANK(H),RANK(V),5))",
    84: "SUM(IF(C>DELAY(C,1),V,IF(C<DELAY(C,1),-V,0)),20)",
    85: "TSRANK(V/(MEAN(V,20)+E),20)*TSRANK(-DELTA(C,7),8)",
    86: "IF(b>0.25,-1,IF(b<0,1,-DELTA(C,1)))  WITH a=DELAY(C,10); b=(DELAY(C,20)-a)/10-(a-C)/10",
    87: "-(RANK(DECAY(DELTA(VW,4),7))+TSRANK(DECAY((L*0.9+L*0.1-VW)/(O-(H+L)/2+E),11),7))",
    88: "(C-a)/(a+E)*100  WITH a=DELAY(C,20)",
    89: "2*(a-EMA(a,10,2))  WITH a=EMA(C,13,2)-EMA(C,27,2)",
    90: "-RANK(CORR(RANK(VW),RANK(V),5))",
    91: "-RANK(C-TSMAX(C,5))*RANK(CORR(MEAN(V,40),L,5))",
    92: "-MAX2(RANK(DECAY(DELTA(C*0.35+VW*0.65,2),3)),TSRANK(DECAY(ABS(CORR(MEAN(V,180),C,13)),5),15))",
    93: "SUM(IF(O>=DELAY(O,1),0,MAX2(O-L,O-DELAY(O,1))),20)",
    94: "SUM(IF(C>DELAY(C,1),V,IF(C<DELAY(C,1),-V,0)),30)",
    95: "STD(AMT,20)",
    96: "EMA(EMA((C-TSMIN(L,9))/(TSMAX(H,9)-TSMIN(L,9)+E)*100,3,1),3,1)",
    97: "STD(V,10)",
    98: "IF(DELTA(SUM(C,100)/100,100)/(DELAY(C,100)+E)<=0.05,-(C-TSMIN(C,100)),-DELTA(C,3))",
    99: "-RANK(COV(RANK(C),RANK(V),5))",
    100: "STD(V,20)",
    101: "-IF(RANK(CORR(C,SUM(MEAN(V,30),37),15))<RANK(CORR(RANK(H*0.1+VW*0.9),RANK(V),11)),1,0)",
    102: "EMA(MAX2(a,0),6,1)/(EMA(ABS(a),6,1)+E)*100  WITH a=V-DELAY(V,1)",
    103: "(20-LOWDAY(L,20))/20*100",
    104: "-DELTA(CORR(H,V,5),5)*RANK(STD(C,20))",
    105: "-CORR(RANK(O),RANK(V),10)",
    106: "C-DELAY(C,20)",
    107: "-RANK(O-DELAY(H,1))*RANK(O-DELAY(C,1))*RANK(O-DELAY(L,1))",
    108: "-SPOW(RANK(H-MIN2(H,DELAY(H,2))),CORR(VW,MEAN(V,120),6))",
    109: "a/(EMA(a,10,2)+E)  WITH a=EMA(H-L,10,2)",
    110: "SUM(MAX2(0,H-DELAY(C,1)),20)/(SUM(MAX2(0,DELAY(C,1)-L),20)+E)*100",
    111: "EMA(a*V,11,2)-EMA(a*V,4,2)  WITH a=(C-L-(H-C))/(H-L+E)",
    112: "(b-c)/(b+c+E)*100  WITH a=C-DELAY(C,1); b=SUM(IF(a>0,a,0),12); c=SUM(IF(a<0,ABS(a),0),12)",
    113: "-RANK(SUM(DELAY(C,5),20)/20)*CORR(C,V,2)*RANK(CORR(SUM(C,5),SUM(C,20),2))",
    114: "RANK(DELAY(a,2))*RANK(RANK(V))/(a/(VW-C+E)+E)  WITH a=(H-L)/(SUM(C,5)/5+E)",
    115: "SPOW(RANK(CORR(H*0.9+C*0.1,MEAN(V,30),10)),RANK(CORR(TSRANK((H+L)/2,4),TSRANK(V,10),7)))",
    116: "SLOPE(C,20)",
    117: "TSRANK(V,32)*(1-TSRANK(C+H-L,16))*(1-TSRANK(RET,32))",
    118: "SUM(H-O,20)/(SUM(O-L,20)+E)*100",
    119: "RANK(DECAY(CORR(VW,SUM(MEAN(V,5),26),5),7))-RANK(DECAY(TSRANK(MIN2(CORR(RANK(O),RANK(MEAN(V,15)),21),9),7),8))",
    120: "RANK(VW-C)/(RANK(VW+C)+E)",
    121: "-SPOW(RANK(VW-MIN2(VW,DELAY(VW,12))),TSRANK(CORR(TSRANK(VW,20),TSRANK(MEAN(V,60),2),18),3))",
    122: "(a-DELAY(a,1))/(DELAY(a,1)+E)  WITH a=EMA(EMA(EMA(LOG(C),13,2),13,2),13,2)",
    123: "-IF(RANK(CORR(SUM((H+L)/2,20),SUM(MEAN(V,60),20),9))<RANK(CORR(L,V,6)),1,0)",
    124: "(C-VW)/(DECAY(RANK(TSMAX(C,30)),2)+E)",
    125: "RANK(DECAY(CORR(VW,MEAN(V,80),17),20))/(RANK(DECAY(DELTA(C*0.5+VW*0.5,3),16))+E)",
    126: "(C+H+L)/3",
    127: "MEAN((100*(C-a)/(a+E))^2,12)^0.5  WITH a=TSMAX(C,12)",
    128: "100-100/(1+SUM(IF((H+L+C)/3>a,(H+L+C)/3*V,0),14)/(SUM(IF((H+L+C)/3<a,(H+L+C)/3*V,0),14)+E))  WITH a=DELAY((H+L+C)/3,1)",
    129: "SUM(IF(a<0,ABS(a),0),12)  WITH a=C-DELAY(C,1)",
    130: "RANK(DECAY(CORR((H+L)/2,MEAN(V,40),9),10))/(RANK(DECAY(CORR(RANK(VW),RANK(V),7),3))+E)",
    131: "SPOW(RANK(DELTA(VW,1)),TSRANK(CORR(C,MEAN(V,50),18),18))",
    132: "MEAN(AMT,20)",
    133: "(20-HIGHDAY(H,20))/20*100-(20-LOWDAY(L,20))/20*100",
    134: "(C-a)/(a+E)*V  WITH a=DELAY(C,12)",
    135: "EMA(DELAY(C/(DELAY(C,20)+E),1),20,1)",
    136: "-RANK(DELTA(RET,3))*CORR(O,V,10)",
    137: "16*(C-DELAY(C,1)+(C-O)/2+DELAY(C,1)-DELAY(O,1))/(IF(a>b AND a>c,a+b/2+ABS(DELAY(C,1)-DELAY(O,1))/4,IF(b>c AND b>a,b+a/2+ABS(DELAY(C,1)-DELAY(O,1))/4,c+ABS(DELAY(C,1)-DELAY(O,1))/4))+E)*MAX2(a,b)  WITH a=ABS(H-DELAY(C,1)); b=ABS(L-DELAY(C,1)); c=ABS(H-DELAY(L,1))",
    138: "-(RANK(DECAY(DELTA(L*0.7+VW*0.3,3),20))-TSRANK(DECAY(TSRANK(CORR(TSRANK(L,8),TSRANK(MEAN(V,60),17),5),19),16),7))",
    139: "-CORR(O,V,10)",
    140: "MIN2(RANK(DECAY(RANK(O)+RANK(L)-RANK(H)-RANK(C),8)),TSRANK(DECAY(CORR(TSRANK(C,8),TSRANK(MEAN(V,60),20),8),7),3))",
    141: "-RANK(CORR(RANK(H),RANK(MEAN(V,15)),9))",
    142: "-RANK(TSRANK(C,10))*RANK(DELTA(DELTA(C,1),1))*RANK(TSRANK(V/(MEAN(V,20)+E),5))",
    143: "CUMPROD(IF(C>DELAY(C,1),(C-DELAY(C,1))/(DELAY(C,1)+E),1))",
    144: "SUMIF(ABS(C/(DELAY(C,1)+E)-1)/(AMT+E),20,a)/(COUNT(a,20)+E)  WITH a=C<DELAY(C,1)",
    145: "(MEAN(V,9)-MEAN(V,26))/(MEAN(V,12)+E)*100",
    146: "MEAN(b,20)*b/(MEAN((b-b)^2,60)+E)  WITH a=(C-DELAY(C,1))/(DELAY(C,1)+E); b=a-EMA(a,61,2)",
    147: "SLOPE(MEAN(C,12),12)",
    148: "-IF(RANK(CORR(O,SUM(MEAN(V,60),9),6))<RANK(O-TSMIN(O,14)),1,0)",
    149: "REGBETA(IF(BMC<DELAY(BMC,1),C/DELAY(C,1)-1,0/0),IF(BMC<DELAY(BMC,1),BMC/DELAY(BMC,1)-1,0/0),252,10)",
    150: "(C+H+L)/3*V",
    151: "EMA(C-DELAY(C,20),20,1)",
    152: "EMA(MEAN(DELAY(a,1),12)-MEAN(DELAY(a,1),26),9,1)  WITH a=EMA(DELAY(C/(DELAY(C,9)+E),1),9,1)",
    153: "(MEAN(C,3)+MEAN(C,6)+MEAN(C,12)+MEAN(C,24))/4",
    154: "IF(VW-MIN2(VW,DELAY(VW,16))<CORR(VW,MEAN(V,180),18),1,0)",
    155: "a-EMA(a,10,2)  WITH a=EMA(V,13,2)-EMA(V,27,2)",
    156: "-MAX2(RANK(DECAY(DELTA(VW,5),3)),RANK(DECAY(-DELTA(O*0.15+L*0.85,2)/(O*0.15+L*0.85+E),3)))",
    157: "MIN2(PROD(RANK(RANK(LOG(SUM(TSMIN(RANK(RANK(-RANK(DELTA(C-1,5)))),2),1)))),1),5)+TSRANK(DELAY(-RET,6),5)",
    158: "(H-a-(L-a))/(C+E)  WITH a=EMA(C,15,2)",
    159: "((C-SUM(a,6))/(SUM(b,6)+E)*12*24+(C-SUM(a,12))/(SUM(b,12)+E)*6*24+(C-SUM(a,24))/(SUM(b,24)+E)*6*24)*100/(6*12+6*24+12*24)  WITH a=MIN2(L,DELAY(C,1)); b=MAX2(H,DELAY(C,1))-a",
    160: "EMA(IF(C<=DELAY(C,1),STD(C,20),0),20,1)",
    161: "MEAN(MAX2(MAX2(H-L,ABS(DELAY(C,1)-H)),ABS(DELAY(C,1)-L)),12)",
    162: "(b-c)/(TSMAX(b,12)-c+E)  WITH a=C-DELAY(C,1); b=EMA(MAX2(a,0),12,1)/(EMA(ABS(a),12,1)+E)*100; c=TSMIN(b,12)",
    163: "RANK(-RET*MEAN(V,20)*VW*(H-C))",
    164: "EMA((a-TSMIN(a,12))/(H-L+E)*100,13,2)  WITH a=IF(C>DELAY(C,1),1/(C-DELAY(C,1)+E),1)",
    165: "TSMAX(a,48)-TSMIN(a,48)/(STD(C,48)+E)  WITH a=CUMSUM(C-MEAN(C,48))",
    166: "-20*(20-1)^1.5*SUM((a-MEAN(a,20))^3,20)/((20-1)*(20-2)*(SUM((a-MEAN(a,20))^2,20)^1.5+E))  WITH a=C/(DELAY(C,1)+E)-1",
    167: "SUM(MAX2(C-DELAY(C,1),0),12)",
    168: "-V/(MEAN(V,20)+E)",
    169: "EMA(MEAN(DELAY(a,1),12)-MEAN(DELAY(a,1),26),10,1)  WITH a=EMA(C-DELAY(C,1),9,1)",
    170: "RANK(1/(C+E))*V/(MEAN(V,20)+E)*H*RANK(H-C)/(SUM(H,5)/5+E)-RANK(VW-DELAY(VW,5))",
    171: "-(L-C)*O^5/((C-H)*C^5+E)",
    172: "MEAN(ABS(d-e)/(d+e+E)*100,6)  WITH a=DELAY(L,1)-L; b=H-DELAY(H,1); c=MAX2(MAX2(H-L,ABS(DELAY(C,1)-H)),ABS(DELAY(C,1)-L)); d=SUM(IF(a>0 AND a>b,a,0),14)*100/(SUM(c,14)+E); e=SUM(IF(b>0 AND b>a,b,0),14)*100/(SUM(c,14)+E)",
    173: "3*a-2*EMA(a,13,2)+EMA(EMA(EMA(LOG(C),13,2),13,2),13,2)  WITH a=EMA(C,13,2)",
    174: "EMA(IF(C>DELAY(C,1),STD(C,20),0),20,1)",
    175: "MEAN(MAX2(MAX2(H-L,ABS(DELAY(C,1)-H)),ABS(DELAY(C,1)-L)),6)",
    176: "CORR(RANK((C-TSMIN(L,12))/(TSMAX(H,12)-TSMIN(L,12)+E)),RANK(V),6)",
    177: "(20-HIGHDAY(H,20))/20*100",
    178: "(C-DELAY(C,1))/(DELAY(C,1)+E)*V",
    179: "RANK(CORR(VW,V,4))*RANK(CORR(RANK(L),RANK(MEAN(V,50)),12))",
    180: "IF(MEAN(V,20)<V,-TSRANK(ABS(DELTA(C,7)),60)*SIGN(DELTA(C,7)),-V)",
    181: "SUM(a-MEAN(a,20)-b^2,20)/(SUM(b^3,20)+E)  WITH a=C/(DELAY(C,1)+E)-1; b=BMC-MEAN(BMC,20)",
    182: "COUNT(C>O AND BMC>BMO OR C<O AND BMC<BMO,20)/20",
    183: "TSMAX(a,24)-TSMIN(a,24)/(STD(C,24)+E)  WITH a=CUMSUM(C-MEAN(C,24))",
    184: "RANK(CORR(DELAY(O-C,1),C,200))+RANK(O-C)",
    185: "RANK(-(1-O/(C+E))^2)",
    186: "(f+DELAY(f,6))/2  WITH a=DELAY(L,1)-L; b=H-DELAY(H,1); c=MAX2(MAX2(H-L,ABS(DELAY(C,1)-H)),ABS(DELAY(C,1)-L)); d=SUM(IF(a>0 AND a>b,a,0),14)*100/(SUM(c,14)+E); e=SUM(IF(b>0 AND b>a,b,0),14)*100/(SUM(c,14)+E); f=MEAN(ABS(d-e)/(d+e+E)*100,6)",
    187: "SUM(IF(O<=DELAY(O,1),0,MAX2(H-O,O-DELAY(O,1))),20)",
    188: "(H-L-a)/(a+E)*100  WITH a=EMA(H-L,11,2)",
    189: "MEAN(ABS(C-MEAN(C,6)),6)",
    190: "LOG((COUNT(a<b,20)-1)*SUMIF((a-b)^2,20,a<b)/(COUNT(a>b,20)*SUMIF((a-b)^2,20,a>b)+E)+E)  WITH a=C/(DELAY(C,1)+E)-1; b=(C/(DELAY(C,19)+E))^(1/20)-1",
    191: "CORR(MEAN(V,20),L,5)+(H+L)/2-C",
}
