"""The 101 published formulaic alphas, in the notation of barloom.functions.algebra."""

#: Formula text by factor number. E stands for 1e-10.
FORMULAS = {
    1: "RANK(ARGMAX(SPOW(IF(RET<0,STD(RET,20),C),2),5))-0.5",
    2: "-CORR(RANK(DELTA(LOG(V),2)),RANK((C-O)/(O+E)),6)",
    3: "-CORR(RANK(O),RANK(V),10)",
    4: "-TSRANK(RANK(L),9)",
    5: "RANK(O-MEAN(VW,10))*(-ABS(RANK(C-VW)))",
    6: "-CORR(O,V,10)",
    7: "IF(ADV(20)<V,-TSRANK(ABS(DELTA(C,7)),60)*SIGN(DELTA(C,7)),-1)",
    8: "-RANK(a-DELAY(a,10))  WITH a=SUM(O,5)*SUM(RET,5)",
    9: "IF(TSMIN(DELTA(C,1),5)>0,DELTA(C,1),IF(TSMAX(DELTA(C,1),5)<0,DELTA(C,1),-DELTA(C,1)))",
    10: "RANK(IF(TSMIN(DELTA(C,1),4)>0,DELTA(C,1),IF(TSMAX(DELTA(C,1),4)<0,DELTA(C,1),-DELTA(C,1))))",
    11: "(RANK(TSMAX(VW-C,3))+RANK(TSMIN(VW-C,3)))*RANK(DELTA(V,3))",
    12: "SIGN(DELTA(V,1))*(-DELTA(C,1))",
    13: "-RANK(COV(RANK(C),RANK(V),5))",
    14: "-RANK(DELTA(RET,3))*CORR(O,V,10)",
    15: "-SUM(RANK(CORR(RANK(H),RANK(V),3)),3)",
    16: "-RANK(COV(RANK(H),RANK(V),5))",
    17: "-RANK(TSRANK(C,10))*RANK(DELTA(DELTA(C,1),1))*RANK(TSRANK(V/(ADV(20)+E),5))",
    18: "-RANK(STD(ABS(C-O),5)+C-O+CORR(C,O,10))",
    19: "-SIGN(C-DELAY(C,7)+DELTA(C,7))*(1+RANK(1+SUM(RET,250)))",
    20: "-RANK(O-DELAY(H,1))*RANK(O-DELAY(C,1))*RANK(O-DELAY(L,1))",
    21: "IF(MEAN(C,8)+STD(C,8)<MEAN(C,2),-1,IF(MEAN(C,2)<MEAN(C,8)-STD(C,8),1,IF(V/(ADV(20)+E)>=1,1,-1)))",
    22: "-DELTA(CORR(H,V,5),5)*RANK(STD(C,20))",
    23: "IF(MEAN(H,20)<H,-DELTA(H,2),0)",
    24: "IF(DELTA(MEAN(C,100),100)/(DELAY(C,100)+E)<=0.05,-(C-TSMIN(C,100)),-DELTA(C,3))",
    25: "RANK(-RET*ADV(20)*VW*(H-C))",
    26: "-TSMAX(CORR(TSRANK(V,5),TSRANK(H,5),5),3)",
    27: "IF(RANK(SUM(CORR(RANK(V),RANK(VW),6),2)/2)>0.5,-1,1)",
    28: "SCALE(CORR(ADV(20),L,5)+(H+L)/2-C)",
    29: "TSMIN(PROD(RANK(RANK(SCALE(LOG(MAX2(SUM(TSMIN(RANK(RANK(-RANK(DELTA(C-1,5)))),2),1),E))))),1),5)+TSRANK(DELAY(-RET,6),5)",
    30: "(1-RANK(SIGN(C-DELAY(C,1))+SIGN(DELAY(C,1)-DELAY(C,2))+SIGN(DELAY(C,2)-DELAY(C,3))))*SUM(V,5)/(SUM(V,20)+E)",
    31: "RANK(RANK(RANK(DECAY(-RANK(RANK(DELTA(C,10))),10))))+RANK(-DELTA(C,3))+SIGN(SCALE(CORR(ADV(20),L,12)))",
    32: "SCALE(MEAN(C,7)-C)+20*SCALE(CORR(VW,DELAY(C,5),230))",
    33: "RANK(-(1-O/(C+E)))",
    34: "RANK(1-RANK(STD(RET,2)/(STD(RET,5)+E))+1-RANK(DELTA(C,1)))",
    35: "TSRANK(V,32)*(1-TSRANK(C+H-L,16))*(1-TSRANK(RET,32))",
    36: "2.21*RANK(CORR(C-O,DELAY(V,1),15))+0.7*RANK(O-C)+0.73*RANK(TSRANK(DELAY(-RET,6),5))+RANK(ABS(CORR(VW,ADV(20),6)))+0.6*RANK((MEAN(C,200)-O)*(C-O))",
    37: "RANK(CORR(DELAY(O-C,1),C,200))+RANK(O-C)",
    38: "-RANK(TSRANK(C,10))*RANK(C/(O+E))",
    39: "-RANK(DELTA(C,7)*(1-RANK(DECAY(V/(ADV(20)+E),9))))*(1+RANK(SUM(RET,250)))",
    40: "-RANK(STD(H,10))*CORR(H,V,10)",
    41: "(H*L)^0.5-VW",
    42: "RANK(VW-C)/(RANK(VW+C)+E)",
    43: "TSRANK(V/(ADV(20)+E),20)*TSRANK(-DELTA(C,7),8)",
    44: "-CORR(H,RANK(V),5)",
    45: "-RANK(MEAN(DELAY(C,5),20))*CORR(C,V,2)*RANK(CORR(SUM(C,5),SUM(C,20),2))",
    46: "IF(a>0.25,-1,IF(a<0,1,-(C-DELAY(C,1))))  WITH a=(DELAY(C,20)-DELAY(C,10))/10-(DELAY(C,10)-C)/10",
    47: "RANK(1/(C+E))*V/(ADV(20)+E)*H*RANK(H-C)/(MEAN(H,5)+E)-RANK(VW-DELAY(VW,5))",
    48: "INDNEUT(CORR(DELTA(C,1),DELTA(DELAY(C,1),1),250)*DELTA(C,1)/(C+E))/(SUM((DELTA(C,1)/(DELAY(C,1)+E))^2,250)+E)",
    49: "IF((DELAY(C,20)-DELAY(C,10))/10-(DELAY(C,10)-C)/10<-0.1,1,-(C-DELAY(C,1)))",
    50: "-TSMAX(RANK(CORR(RANK(V),RANK(VW),5)),5)",
    51: "IF((DELAY(C,20)-DELAY(C,10))/10-(DELAY(C,10)-C)/10<-0.05,1,-(C-DELAY(C,1)))",
    52: "(-TSMIN(L,5)+DELAY(TSMIN(L,5),5))*RANK((SUM(RET,240)-SUM(RET,20))/220)*TSRANK(V,5)",
    53: "-DELTA((C-L-(H-C))/(C-L+E),9)",
    54: "-(L-C)*O^5/((L-H+E)*C^5+E)",
    55: "-CORR(RANK((C-TSMIN(L,12))/(TSMAX(H,12)-TSMIN(L,12)+E)),RANK(V),6)",
    56: "-RANK(SUM(RET,10)/(SUM(SUM(RET,2),3)+E))*RANK(RET*CAP)",
    57: "-(C-VW)/(DECAY(RANK(ARGMAX(C,30)),2)+E)",
    58: "-TSRANK(DECAY(CORR(INDNEUT(VW),V,4),8),6)",
    59: "-TSRANK(DECAY(CORR(INDNEUT(VW),V,4),16),8)",
    60: "-(2*SCALE(RANK((C-L-(H-C))/(H-L+E)*V))-SCALE(RANK(ARGMAX(C,10))))",
    61: "NUM(RANK(VW-TSMIN(VW,16))<RANK(CORR(VW,ADV(180),18)))",
    62: "-NUM(RANK(CORR(VW,SUM(ADV(20),22),10))<RANK(NUM(RANK(O)+RANK(O)<RANK((H+L)/2)+RANK(H))))",
    63: "-(RANK(DECAY(DELTA(INDNEUT(C),2),8))-RANK(DECAY(CORR(VW*0.318108+O*(1-0.318108),SUM(ADV(180),37),14),12)))",
    64: "-NUM(RANK(CORR(SUM(O*0.178404+L*(1-0.178404),13),SUM(ADV(120),13),17))<RANK(DELTA((H+L)/2*0.178404+VW*(1-0.178404),4)))",
    65: "-NUM(RANK(CORR(O*0.00817205+VW*(1-0.00817205),SUM(ADV(60),9),6))<RANK(O-TSMIN(O,14)))",
    66: "-(RANK(DECAY(DELTA(VW,4),7))+TSRANK(DECAY((L-VW)/(O-(H+L)/2+E),11),7))",
    67: "-RANK(H-TSMIN(H,2))^RANK(CORR(INDNEUT(VW),INDNEUT(ADV(20)),6))",
    68: "-NUM(TSRANK(CORR(RANK(H),RANK(ADV(15)),9),14)<RANK(DELTA(C*0.518371+L*(1-0.518371),1)))",
    69: "-RANK(TSMAX(DELTA(INDNEUT(VW),3),5))^TSRANK(CORR(C*0.490655+VW*(1-0.490655),ADV(20),5),9)",
    70: "-RANK(DELTA(VW,1))^TSRANK(CORR(INDNEUT(C),ADV(50),18),18)",
    71: "MAX2(TSRANK(DECAY(CORR(TSRANK(C,3),TSRANK(ADV(180),12),18),4),16),TSRANK(DECAY(RANK(L+O-2*VW)^2,16),4))",
    72: "RANK(DECAY(CORR((H+L)/2,ADV(40),9),10))/(RANK(DECAY(CORR(TSRANK(VW,4),TSRANK(V,19),7),3))+E)",
    73: "-MAX2(RANK(DECAY(DELTA(VW,5),3)),TSRANK(DECAY(-DELTA(a,2)/(a+E),3),17))  WITH a=O*0.147155+L*(1-0.147155)",
    74: "-NUM(RANK(CORR(C,SUM(ADV(30),37),15))<RANK(CORR(RANK(H*0.0261661+VW*(1-0.0261661)),RANK(V),11)))",
    75: "NUM(RANK(CORR(VW,V,4))<RANK(CORR(RANK(L),RANK(ADV(50)),12)))",
    76: "-MAX2(RANK(DECAY(DELTA(VW,1),12)),TSRANK(DECAY(TSRANK(CORR(INDNEUT(L),ADV(81),8),20),17),19))",
    77: "MIN2(RANK(DECAY((H+L)/2-VW,20)),RANK(DECAY(CORR((H+L)/2,ADV(40),3),6)))",
    78: "RANK(CORR(SUM(L*0.352233+VW*(1-0.352233),20),SUM(ADV(40),20),7))^RANK(CORR(RANK(VW),RANK(V),6))",
    79: "NUM(RANK(DELTA(INDNEUT(C*0.60733+O*(1-0.60733)),1))<RANK(CORR(TSRANK(VW,4),TSRANK(ADV(150),9),15)))",
    80: "-RANK(SIGN(DELTA(INDNEUT(O*0.868128+H*(1-0.868128)),4)))^TSRANK(CORR(H,ADV(10),5),6)",
    81: "-NUM(RANK(LOG(PROD(RANK(RANK(CORR(VW,SUM(ADV(10),50),8))^4),15)))<RANK(CORR(RANK(VW),RANK(V),5)))",
    82: "-MIN2(RANK(DECAY(DELTA(O,1),15)),TSRANK(DECAY(CORR(INDNEUT(V),O,17),7),13))",
    83: "RANK(DELAY(a,2))*RANK(RANK(V))/(a/(VW-C+E)+E)  WITH a=(H-L)/(MEAN(C,5)+E)",
    84: "SPOW(TSRANK(VW-TSMAX(VW,15),21),DELTA(C,5))",
    85: "RANK(CORR(H*0.876703+C*(1-0.876703),ADV(30),10))^RANK(CORR(TSRANK((H+L)/2,4),TSRANK(V,10),7))",
    86: "-NUM(TSRANK(CORR(C,SUM(ADV(20),15),6),20)<RANK(C-VW))",
    87: "-MAX2(RANK(DECAY(DELTA(C*0.369701+VW*(1-0.369701),1),3)),TSRANK(DECAY(ABS(CORR(INDNEUT(ADV(81)),C,13)),5),14))",
    88: "MIN2(RANK(DECAY(RANK(O)+RANK(L)-RANK(H)-RANK(C),8)),TSRANK(DECAY(CORR(TSRANK(C,8),TSRANK(ADV(60),21),8),7),3))",
    89: "TSRANK(DECAY(CORR(L,ADV(10),7),6),4)-TSRANK(DECAY(DELTA(INDNEUT(VW),3),10),15)",
    90: "-RANK(C-TSMAX(C,5))^TSRANK(CORR(INDNEUT(ADV(40)),L,5),3)",
    91: "-(TSRANK(DECAY(DECAY(CORR(INDNEUT(C),V,10),16),4),5)-RANK(DECAY(CORR(VW,ADV(30),4),3)))",
    92: "MIN2(TSRANK(DECAY(NUM((H+L)/2+C<L+O),15),19),TSRANK(DECAY(CORR(RANK(L),RANK(ADV(30)),8),7),7))",
    93: "TSRANK(DECAY(CORR(INDNEUT(VW),ADV(81),17),20),8)/(RANK(DECAY(DELTA(C*0.524434+VW*(1-0.524434),3),16))+E)",
    94: "-RANK(VW-TSMIN(VW,12))^TSRANK(CORR(TSRANK(VW,20),TSRANK(ADV(60),4),18),3)",
    95: "NUM(RANK(O-TSMIN(O,12))<TSRANK(RANK(CORR(SUM((H+L)/2,19),SUM(ADV(40),19),13))^5,12))",
    96: "-MAX2(TSRANK(DECAY(CORR(RANK(VW),RANK(V),4),4),8),TSRANK(DECAY(ARGMAX(CORR(TSRANK(C,7),TSRANK(ADV(60),4),4),13),14),13))",
    97: "-(RANK(DECAY(DELTA(INDNEUT(L*0.721001+VW*(1-0.721001)),3),20))-TSRANK(DECAY(TSRANK(CORR(TSRANK(L,8),TSRANK(ADV(60),17),5),19),16),7))",
    98: "RANK(DECAY(CORR(VW,SUM(ADV(5),26),5),7))-RANK(DECAY(TSRANK(ARGMIN(CORR(RANK(O),RANK(ADV(15)),21),9),7),8))",
    99: "-NUM(RANK(CORR(SUM((H+L)/2,20),SUM(ADV(60),20),9))<RANK(CORR(L,V,6)))",
    100: "-(1.5*SCALE(INDNEUT(INDNEUT(RANK(((C-L)-(H-C))/(H-L+E)*V)))) - SCALE(INDNEUT(CORR(C,RANK(ADV(20)),5)-RANK(ARGMIN(C,30)))))*V/(ADV(20)+E)",
    101: "(C-O)/(H-L+0.001)",
}
